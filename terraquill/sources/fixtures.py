"""Captions, detections and images derived from the driver's tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill import vocab
from terraquill.functions import kernels
from terraquill.operators.ordinal import numbered
from terraquill.operators.shared import shared_folder
from terraquill.sinks import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(terms, index):
    return F.element_at(F.array(*map(F.lit, terms)), index.cast("int") + 1)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One caption for each document, with vocabulary put in front; every 17th is an error."""
    d = F.col("doc_id")
    kw = vocab.AERIAL_KEYWORDS
    lead = F.concat(F.lit("The image shows "), (d % 7).cast("string"), F.lit(" "), _pick(kw, d % 28), F.lit(" near the "), _pick(vocab.SPATIAL_TERMS, d % 10), F.lit(" and "), (d % 5).cast("string"), F.lit(" "), _pick(kw, (d * 5 + 3) % 28), F.lit(". "))
    return table(spark, sf_dir, "documents").select(
        d.alias("image_id"), (d % 4).alias("model_ord"), _pick([m.key for m in vocab.MODELS], d % 4).alias("model_key"), F.concat(lead, F.col("text")).alias("caption"),
        (F.col("n_chars") / F.lit(1000.0)).alias("inference_time"), (d % 17 == 3).alias("is_error"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each order line; sixteen order numbers make an image, so images grow with the table."""
    # The image is a column before it is a window's key, so what groups by it later needs no further shuffle.
    lines = table(spark, sf_dir, "lineitem").withColumn("image_id", F.shiftright("l_orderkey", 4))
    lines = numbered(lines, ["image_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "det_idx")
    return lines.select(
        "image_id", "det_idx", _pick(vocab.DETECT_CLASSES, F.col("l_partkey") % 32).alias("label"),
        (F.col("l_quantity") / F.lit(50.0)).alias("score"), (F.col("l_partkey") * 37 % 1024).alias("center_x"), (F.col("l_suppkey") * 53 % 1024).alias("center_y"),
        F.when(F.col("l_discount") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("l_extendedprice") * 4).cast("long")).alias("area"), F.lit(1024).alias("img_w"), F.lit(1024).alias("img_h"),
    )


def page_pixels(page_id: int, html: str | None) -> np.ndarray | None:
    """A page's UTF-8 bytes as pixels, zeros at the end, as nearly square as can be: gray where the id is even, else in three
    colours. Nothing for pages without text, and for every sixteenth."""
    data = (html or "").encode()
    if not data or page_id % 16 == 3:
        return None
    channels = 3 if page_id % 2 else 1
    pixels = -(-len(data) // channels)
    width = math.isqrt(pixels - 1) + 1
    height = -(-pixels // width)
    return np.frombuffer(data.ljust(height * width * channels, b"\0"), np.uint8).reshape(height, width, channels)


def page_images(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each row of `pages`: page_<id>.png of its pixels, else page_<id>.jpg that is no image.

    Executors write the files, each under its final name only when it is whole, so a task that runs again replaces its files
    by equal ones. An application makes the folder of a table once; a marker says that all its files are there.
    """
    folder = f"{shared_folder(spark)}/pages-{spark.sparkContext.applicationId}-{sha256(sf_dir.encode()).hexdigest()[:16]}"
    if files.there(f"{folder}/_SUCCESS"):
        return folder

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                image = page_pixels(page_id, html)
                ending, data = ("jpg", b"\\xff\\xd8 not an image") if image is None else ("png", kernels.png(image))
                files.put(f"{folder}/page_{page_id}.{ending}", data)
            yield pdf[["page_id"]]

    pages = table(spark, sf_dir, "pages").select("page_id", "html").where("page_id IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages.repartition(parts, "page_id").mapInPandas(write, "page_id long").write.format("noop").mode("overwrite").save()
    files.put(f"{folder}/_SUCCESS", b"")
    return folder
