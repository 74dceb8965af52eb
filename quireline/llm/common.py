"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows a Python worker holds at once; texts can be long, so batches are short.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode without a setting."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.gettempdir() + "/quireline-shared"
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files at its end; else they stay until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting has this value within the block, and what it had before after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and rereads it: lineage ends here, and lost executors cost nothing before it.

    The table goes at the end of the scratch() block it was made in, unless it is kept, or else when the driver ends. What was
    shuffled for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    _MADE.append(path)
    with setting(spark, DROP_SHUFFLES, "true"):
        df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


#: Paths of stored tables that may still be there, oldest first.
_MADE: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stored tables made in the block are deleted at its end, but for those passed through what it yields.

    Results that are read later must hang on kept tables alone.
    """
    mark, kept = len(_MADE), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._path)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _MADE[mark:] if p not in kept]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _MADE.remove(path)


#: Bytes of a side of a join that may be sent to all tasks.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """Marked for sending to all tasks if its bytes, which are counted, are within the bound; else it stays for a shuffled join.

    Numbers count 16 bytes (value and place in the table), texts and binaries their own besides.
    """
    wide = [F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    lists = [F.coalesce(8 * F.greatest(F.size(quoted(f.name)), F.lit(0)), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString().startswith("array")]
    row = sum([*wide, *lists], F.lit(16 * len(df.columns)))
    size = df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: Spark's Arrow functions don't take names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def quoted(name: str) -> Column:
    """A column by its plain name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers receive at once, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def row_key(*cols: str) -> Column:
    """The same for equal rows, and for every reading of a row; nulls count as values."""
    return F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(parts)
