"""What all operators of this subpackage share: folders that every executor sees, size checks, cheap lineage cuts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a lookup table that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 400_000


#: Rows and bytes of an Arrow batch: texts are long, and a worker holds several arrays of a batch's size.
BATCH_ROWS, BATCH_BYTES = "2000", "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers. Applies to the session, where it isn't set smaller already."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving back the memory that a task freed: its worker lives on, idle or with the next stage's tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset (tests on one machine) a local one is made."""
    small_batches(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="terraquill-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a cut table that one task reads, at least.
TASK_ROWS = 100_000


def counted(df: DataFrame, *more: Column) -> tuple[DataFrame, Row]:
    """As `cut`, with the number of rows as `rows`, and further aggregates, seen while they are written."""
    shared_dir(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("rows"), *more).checkpoint(eager=True)
    state = Row(**seen.get)
    # A shuffle writes files for each task: tasks are as many as the rows need, and at least one for each core.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-state.rows // TASK_ROWS))
    return kept.coalesce(tasks), state


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; survives lost executors."""
    return counted(df)[0]


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """As `cut`, as Parquet: smaller where values repeat, such as file names. Its path is added to `paths`."""
    path = new_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lookup_join(df: DataFrame, table: DataFrame, on: list[str] | str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a table that is broadcast only if its counted rows are few; otherwise Spark shuffles both sides."""
    rows = table.count() if rows is None else rows
    return df.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, on, how)


def text_of(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task numbers, about.
BLOCK_ROWS = 200_000


ROW = "_row"


def with_places(df: DataFrame) -> tuple[DataFrame, int]:
    """df, cut, with a long `_row` of its own for each row, and the number of rows; `_row` is kept, not computed again."""
    df, state = counted(df.withColumn(ROW, F.monotonically_increasing_id()))
    return df, state.rows


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Adds a gapless long number from 0 within each group, without gathering a group, or rows equal in `order`, in one task.

    df, a table of `rows` rows from `with_places`, is dealt to blocks by a hash of `order` and `_row`, which it loses. Each
    block is numbered alone and starts where the blocks before it in its group end. The table of block starts has at most
    (groups x blocks) rows.
    """
    b, c, s = "_block", "_count", "_start"
    blocks = max(64, -(-rows // BLOCK_ROWS))
    df = df.withColumn(b, F.pmod(F.xxhash64(*order, ROW), F.lit(blocks)).cast("int"))
    counts = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias(c))
    before = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, b, F.coalesce(F.sum(c).over(before), F.lit(0)).alias(s))
    keys = [*group, b]
    own = W.partitionBy(*keys).orderBy(*order, ROW)
    got = df.withColumn(out, F.row_number().over(own).cast("long") - 1)
    left, right = got.alias("l"), (F.broadcast(starts) if blocks <= BROADCAST_ROWS // 100 else starts).alias("r")
    same = None
    for k in keys:
        e = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = e if same is None else same & e
    kept = [F.col(f"l.{x}").alias(x) for x in got.columns if x not in (b, out, ROW)]
    return left.join(right, same).select(*kept, (F.col(f"l.{out}") + F.col(f"r.{s}")).alias(out))
