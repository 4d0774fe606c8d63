"""Detections of images: filter, counts, totals, top labels, texts. Keys shuffle once per image; nothing else moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquill import vocab


def confident(det: DataFrame, least: float = vocab.SCORE_LEAST) -> DataFrame:
    return det.where(F.col("score") >= least)


def long_form(boxes: DataFrame) -> DataFrame:
    """(image_name, det_idx, box, score, label) of parallel arrays; null or empty arrays give no row."""
    zipped = F.arrays_zip("boxes", "scores", "labels")
    rows = boxes.select("image_name", F.posexplode(zipped).alias("det_idx", "d"))
    return rows.select("image_name", F.col("det_idx").cast("long").alias("det_idx"), F.col("d.boxes").alias("box"), F.col("d.scores").alias("score"), F.col("d.labels").alias("label"))


def counts(det: DataFrame) -> DataFrame:
    """(image_id, label, n, ord): ord is the first detection with the label."""
    return det.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("det_idx").alias("ord"))


def totals(det: DataFrame) -> DataFrame:
    return det.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))


def top_labels(det: DataFrame, k: int = vocab.TOP_LABELS) -> DataFrame:
    order = W.partitionBy("image_id").orderBy(F.desc("n"), "ord")
    ranked = counts(det).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= k).select("image_id", "rank", "label", "n")


def _text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["label"])), ", ")


def label_counts(cells: Column) -> Column:
    """From an image's cells (ord, label, n, position): (ord, label, n) by label, in order of appearance."""

    def one(label: Column) -> Column:
        own = F.filter(cells, lambda c: c["label"] == label)
        n = F.aggregate(own, F.lit(0).cast("long"), lambda s, c: s + c["n"])
        return F.struct(F.array_min(F.transform(own, lambda c: c["ord"])).alias("ord"), label.alias("label"), n.alias("n"))

    return F.array_sort(F.transform(F.array_distinct(F.transform(cells, lambda c: c["label"])), one))


def counts_text(labels: Column) -> Column:
    return _text(labels)


def summary_text(labels: Column, k: int = vocab.TOP_LABELS) -> Column:
    """The k labels with most detections, ties in order of appearance."""
    most = F.array_sort(F.transform(labels, lambda x: F.struct((-x["n"]).alias("less"), x["ord"].alias("ord"), x["label"].alias("label"), x["n"].alias("n"))))
    return _text(F.slice(most, 1, k))


def texts(det: DataFrame) -> DataFrame:
    """(image_id, total, counts_text, summary) in one pass over the label counts."""
    per_image = counts(det).groupBy("image_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("ord", "label", "n"))).alias("labels"))
    return per_image.select("image_id", "total", counts_text(F.col("labels")).alias("counts_text"), summary_text(F.col("labels")).alias("summary"))
