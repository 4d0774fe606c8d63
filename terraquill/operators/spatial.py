"""Where detections lie: masks to points, points to a 3 x 3 grid, grid to text.

A mask is an array of runs (start, n): n pixels from `start` on, counted by lines of `width` pixels from the upper left corner,
ascending and apart. Its area and centre come from sums of arithmetic series over its runs, so the cost of a mask is that of
its outline and not of its area, and a detection stays one row. A mask may have 3 x 10^9 pixels (sums of places fit a long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquill import vocab
from terraquill.functions import expr


def mask_geometry(pixels: DataFrame) -> DataFrame:
    """(image_name, det_idx, center_x, center_y, area) of masks given as pixels; masks without a pixel vanish."""
    inside = pixels.where(F.col("v") > vocab.MASK_ABOVE)
    return inside.groupBy("image_name", "det_idx").agg(
        F.floor(F.avg("x")).cast("long").alias("center_x"), F.floor(F.avg("y")).cast("long").alias("center_y"), F.count(F.lit(1)).alias("area")
    )


RUNS = "array<struct<start: bigint, n: bigint>>"


def line_runs(xs: Column) -> Column:
    """The runs of an ascending array of distinct columns of one line, as (x, n)."""
    begins = F.filter(xs, lambda x: ~F.array_contains(xs, x - 1))
    ends = F.filter(xs, lambda x: ~F.array_contains(xs, x + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.cast("long").alias("x"), (b - a + 1).cast("long").alias("n")))


def box_runs(line: Column, top: Column, bottom: Column, width: Column) -> Column:
    """The mask that has the runs (x, n) of `line` on each line from top to bottom."""
    on = lambda y: F.transform(line, lambda r: F.struct((y.cast("long") * width + r["x"]).alias("start"), r["n"].alias("n")))
    return F.flatten(F.transform(F.sequence(top, bottom), on))


def counts_runs(counts: Column) -> Column:
    """A mask from alternating run lengths, outside first, as masks are often stored."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), F.array().cast(RUNS).alias("runs"))

    def step(s: Column, n: Column) -> Column:
        own = F.array(F.struct(s["at"].alias("start"), n.cast("long").alias("n")))
        return F.struct((s["at"] + n).alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"] & (n > 0), F.concat(s["runs"], own)).otherwise(s["runs"]).alias("runs"))

    return F.aggregate(counts, state, step, lambda s: s["runs"])


def run_masks(pixels: DataFrame, width: int) -> DataFrame:
    """(image_name, det_idx, width, runs) of masks given as pixels (x, y, v); masks without a pixel vanish.

    A line's pixels are joined to runs before a mask's lines meet, so what is gathered for a mask is its outline.
    """
    inside = pixels.where(F.col("v") > vocab.MASK_ABOVE).select("image_name", "det_idx", "y", "x").distinct()
    keys = ["image_name", "det_idx"]
    gap = F.col("x") - F.row_number().over(W.partitionBy(*keys, "y").orderBy("x"))
    runs = inside.withColumn("_gap", gap).groupBy(*keys, "y", "_gap").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n"))
    item = F.struct((F.col("y").cast("long") * width + F.col("x")).alias("start"), F.col("n").cast("long").alias("n"))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("runs")).select(*keys, F.lit(width).cast("long").alias("width"), "runs")


def _rows_below(n: Column, width: Column) -> Column:
    """The sum of p div width over p = 0 .. n - 1."""
    q, r = F.floor(n / width), n % width
    return width * F.floor(q * (q - 1) / 2) + r * q


def run_geometry(masks: DataFrame) -> DataFrame:
    """(image_name, det_idx, center_x, center_y, area) of masks given as runs; masks without a pixel vanish."""
    width = F.col("width").cast("long")
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("area", "place", "y")))

    def add(s: Column, r: Column) -> Column:
        a, n = r["start"], r["n"]
        return F.struct((s["area"] + n).alias("area"), (s["place"] + a * n + F.floor(n * (n - 1) / 2)).alias("place"), (s["y"] + _rows_below(a + n, width) - _rows_below(a, width)).alias("y"))

    sums = masks.select("image_name", "det_idx", width.alias("_w"), F.aggregate("runs", zero, add).alias("_s")).where("_s.area > 0")
    x = F.col("_s.place") - F.col("_w") * F.col("_s.y")
    mean = lambda c: F.floor(c / F.col("_s.area")).cast("long")
    return sums.select("image_name", "det_idx", mean(x).alias("center_x"), mean(F.col("_s.y")).alias("center_y"), F.col("_s.area").alias("area"))


def located(det: DataFrame) -> DataFrame:
    """Detections with position, relative size and size class; those with an empty mask vanish."""
    size = expr.relative_size(F.col("area"), F.col("img_w"), F.col("img_h"))
    rows = det.where("area > 0").withColumn("position", expr.grid_position(F.col("center_x"), F.col("center_y"), F.col("img_w"), F.col("img_h")))
    return rows.withColumn("relative_size", size).withColumn("size_description", expr.size_class(F.col("relative_size"))).withColumnRenamed("label", "object")


def unlocated(det: DataFrame) -> DataFrame:
    """The detections that `located` has no row for, in the same pass."""
    return det.where("area IS NULL OR area <= 0")


def position_counts(locations: DataFrame) -> DataFrame:
    """(image_id, position, object, n, ord)."""
    return locations.groupBy("image_id", "position", "object").agg(F.count(F.lit(1)).alias("n"), F.min("det_idx").alias("ord"))


def _place_text(position: Column, objects: Column) -> Column:
    """One position with its objects (ord, object, n), in order of appearance."""
    named = lambda o: F.concat(o["n"].cast("string"), F.lit(" "), o["object"], F.when(o["n"] > 1, "s").otherwise(""))
    one, place = objects[0], F.concat(F.lit(" in "), position)
    single = F.when(one["n"] == 1, F.concat(one["object"], place)).otherwise(F.concat(named(one), place))
    return F.when(F.size(objects) == 1, single).otherwise(F.concat(F.array_join(F.transform(objects, named), ", "), place))


def _listed(parts: Column, most: int) -> Column:
    """Texts (ord, text) of the first positions in order of appearance."""
    return F.array_join(F.transform(F.slice(F.array_sort(parts), 1, most), lambda p: p["text"]), "; ")


def description(cells: Column, most: int = vocab.TOP_POSITIONS) -> Column:
    """From an image's cells (ord, label, n, position); null where no cell has a position."""
    there = F.filter(cells, lambda c: c["position"].isNotNull())

    def part(position: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(there, lambda c: c["position"] == position), lambda c: F.struct(c["ord"].alias("ord"), c["label"].alias("object"), c["n"].alias("n"))))
        return F.struct(own[0]["ord"].alias("ord"), _place_text(position, own).alias("text"))

    return F.when(F.size(there) > 0, _listed(F.transform(F.array_distinct(F.transform(there, lambda c: c["position"])), part), most))


def descriptions(locations: DataFrame, most: int = vocab.TOP_POSITIONS) -> DataFrame:
    """(image_id, spatial_description): the first positions in order of appearance, each with its objects."""
    groups = position_counts(locations).groupBy("image_id", "position").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "object", "n"))).alias("objects"))
    parts = groups.select("image_id", F.struct("ord", _place_text(F.col("position"), F.col("objects")).alias("text")).alias("part"))
    return parts.groupBy("image_id").agg(_listed(F.collect_list("part"), most).alias("spatial_description"))
