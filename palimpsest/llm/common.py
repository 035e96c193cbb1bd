"""What the operators share: the scratch folder, word splitting and small column helpers.

Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and
carriage return.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel with the tasks, so executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: White space that separates words.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = "[ \\t-\\r]+"
#: Rows of a narrow table (about 24 bytes a row) up to which it is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 4_000_000
#: Bytes of an Arrow batch while tables are staged. Each task holds one outside the heap and up to twice that while it grows, its worker another.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of our own beside the warehouse if driver and executors are one process; on a cluster that is an
    error, as such a folder may be local to one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder under the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    files, where = _folder(spark, path)
    files.deleteOnExit(where)
    return path


@contextmanager
def light_batches(spark: SparkSession) -> Iterator[None]:
    """Within it rows go to Python in batches of ARROW_BYTES at most (at least one row); a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", before.strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") <= ARROW_BYTES:
        yield
        return
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage with a copy that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    with light_batches(spark):
        df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(schema).parquet(path)


#: Staged folders, in the order in which they were written.
_STAGED: list[str] = []


def staged() -> int:
    """A mark for drop_staged."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, mark: int, end: int | None = None) -> None:
    """Deletes what was staged since the mark, up to end; call it when no result that reads it is still to be computed."""
    for path in _STAGED[mark:end]:
        files, where = _folder(spark, path)
        files.delete(where, True)
    del _STAGED[mark:end]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every staged table under the shared folder; call it when no staged result is still to be read."""
    _STAGED.clear()
    files, where = _folder(spark, f"{shared_dir(spark)}/palimpsest")
    files.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, also where body uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; an empty array for null and for texts without a word."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; df must be staged and narrow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucket(key: Column, n: int) -> Column:
    """crc32 of a key's decimal digits, mod n: the fold of a document."""
    return F.crc32(key.cast("string").cast("binary")) % n
