"""Gapless numbers in order within groups, where a group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquill.operators.shared import cut

#: Rows of a group that one task may sort.
HOT_ROWS = 1_000_000

_BLOCK, _START, _ROW, _HOT = "_block", "_start", "_row", "_hot"


def _window(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))


def _same(left: str, right: str, keys: list[str]) -> Column:
    one = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    out = one[0]
    for e in one[1:]:
        out = out & e
    return out


def by_blocks(df: DataFrame, group: list[str], order: list[str], out: str, blocks: int) -> DataFrame:
    """Numbers from 1 by range blocks: no task holds more than a block of a group, however large the group is.

    Rows are range-partitioned by group and order (and their place, so equal rows are dealt out too) to `blocks` blocks,
    which are kept. Within a block a group is numbered alone; where it goes on from blocks before, it begins after their
    rows. In a range partitioning only one group goes over each border, so the table of such beginnings has fewer rows than
    there are blocks, whatever the data, and is broadcast.
    """
    placed = df.withColumn(_ROW, F.monotonically_increasing_id())
    placed = cut(placed.repartitionByRange(blocks, *group, *order, _ROW).withColumn(_BLOCK, F.spark_partition_id()))
    counts = placed.groupBy(*group, _BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn(_START, F.sum("_n").over(before)).where(F.col(_START) > 0).select(*group, _BLOCK, _START)
    own = _window(placed, [*group, _BLOCK], [*order, _ROW], out)
    joined = own.alias("l").join(F.broadcast(starts).alias("r"), _same("l", "r", [*group, _BLOCK]), "left")
    return joined.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col(f"l.{out}") + F.coalesce(f"r.{_START}", F.lit(0))).alias(out))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, hot: int = HOT_ROWS) -> DataFrame:
    """df with a long `out`: 1, 2, ... within each group, by order; null groups are one group.

    Groups of at most `hot` rows are numbered by a window, one shuffle. Larger ones (of which there can't be more than
    rows / hot, so their table is broadcast) go by range blocks of about `hot` rows.
    """
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).collect()
    if not large:
        return _window(df, group, order, out)
    spark = df.sparkSession
    keys = spark.createDataFrame([tuple(r[g] for g in group) for r in large], df.select(*group).schema)
    marked = df.alias("l").join(F.broadcast(keys.withColumn(_HOT, F.lit(True))).alias("r"), _same("l", "r", group), "left")
    marked = marked.select(*(F.col(f"l.`{c}`") for c in df.columns), F.coalesce(f"r.{_HOT}", F.lit(False)).alias(_HOT))
    blocks = max(2, -(-sum(r["_n"] for r in large) // hot) * 2)
    return _window(marked.where(~F.col(_HOT)).drop(_HOT), group, order, out).unionByName(by_blocks(marked.where(_HOT).drop(_HOT), group, order, out, blocks))
