"""Progress as a stream: results arrive, a keyed table and its summary follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import upsert


def _versions(spark: SparkSession, path: str) -> dict[int, object]:
    """Complete versions: those whose writer has left its mark, which it does last."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    listed = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    folders = [s.getPath().getParent() for s in listed or []]
    return {int(f.getName().partition("=")[2]): f for f in folders}


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table as of its last complete version (before an epoch, if asked), or None where there is none."""
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={max(known)}") if known else None


def merge_batch(path: str, keys: list[str], order: list[str], keep: int = 3):
    """For foreachBatch: writes a new version with the batch merged into the last one before it.

    A version counts from the moment it is whole, so a crash at any point leaves the one before; a batch that runs twice gives the
    same table. All but the last few versions are removed afterwards.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path, epoch)
        merged = upsert(old if old is not None else batch.limit(0), batch, keys, order)
        merged.write.mode("overwrite").parquet(f"{path}/v={epoch}")
        versions = _versions(spark, path)
        for v in sorted(versions)[:-keep]:
            versions[v].getFileSystem(spark._jsc.hadoopConfiguration()).delete(versions[v], True)

    return run


def start_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Available input is merged in micro-batches; a restart goes on where the checkpoint ends."""
    return stream.writeStream.foreachBatch(merge_batch(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: counts by tumbling window under a watermark; closed windows only, in append mode."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def tail(c: Column, most: int = 4000) -> Column:
    """The last characters of a growing log."""
    return F.right(c, F.lit(most))
