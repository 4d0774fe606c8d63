"""Prompts of images from captions, detections and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill import vocab
from terraquill.functions import expr
from terraquill.operators import detect, spatial
from terraquill.sinks import tables
from terraquill.vocab import Template


def image_facts(det: DataFrame) -> DataFrame:
    """(image_id, total, counts_text, summary, spatial_description): confident detections; locations may be missing.

    One grouped pass for texts and locations: an image's detections become a cell for each label and position, of which
    there are few, and both texts are made from its cells.
    """
    rows = detect.confident(det)
    where = expr.grid_position(F.col("center_x"), F.col("center_y"), F.col("img_w"), F.col("img_h"))
    rows = rows.select("image_id", "det_idx", "label", F.when(F.col("area") > 0, where).alias("position"))
    cells = rows.groupBy("image_id", "label", "position").agg(F.count(F.lit(1)).alias("n"), F.min("det_idx").alias("ord"))
    images = cells.groupBy("image_id").agg(F.sum("n").alias("total"), F.collect_list(F.struct("ord", "label", "n", "position")).alias("cells"))
    labels = detect.label_counts(F.col("cells"))
    return images.select("image_id", "total", detect.counts_text(labels).alias("counts_text"), detect.summary_text(labels).alias("summary"), spatial.description(F.col("cells")).alias("spatial_description"))


def with_facts(captions: DataFrame, facts: DataFrame) -> DataFrame:
    """captions with the facts of their images; an image without confident detections has total 0 and empty texts."""
    there = F.col("_there").isNotNull()
    rows = captions.join(facts.withColumn("_there", F.lit(True)), "image_id", "left")
    empty = {"total": F.lit(0).cast("long"), "counts_text": F.lit(""), "summary": F.lit("")}
    return rows.withColumns({c: F.when(there, F.col(c)).otherwise(none) for c, none in empty.items()}).drop("_there")


def combined(rows: DataFrame, template: Template = vocab.PRODUCTION) -> DataFrame:
    """Rows of captions and facts with prompt, word_count and est_tokens."""
    rows = rows.withColumn("summary", expr.enhanced_summary(F.col("summary"), F.col("spatial_description")))
    rows = rows.withColumn("prompt", expr.combine_prompt(*map(F.col, ("caption", "counts_text", "total", "summary")), template))
    rows = rows.withColumn("word_count", expr.word_count(F.col("prompt")))
    return rows.withColumn("est_tokens", expr.token_estimate(F.col("word_count")))


def prompts(captions: DataFrame, det: DataFrame, template: Template = vocab.PRODUCTION) -> DataFrame:
    """captions (image_id, caption) with prompt, word_count and est_tokens; images without detections get the plain one."""
    return combined(with_facts(captions, image_facts(det)), template)


def co_located(captions: DataFrame, det: DataFrame, folder: str, buckets: int) -> DataFrame:
    """captions with the facts of their images, joined where both lie: nothing is shuffled for the join.

    Captions and facts are stored by image in tables of as many buckets, so later joins by image read bucket by bucket, and
    a caption's text moves once, when it is stored, however often prompts are made of it. folder: where the tables go.
    """
    return with_facts(tables.by_key(captions, "image_id", folder, buckets), tables.by_key(image_facts(det), "image_id", folder, buckets))
