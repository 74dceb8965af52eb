"""quireline: text-collection structuring and evaluation analytics on Spark."""
