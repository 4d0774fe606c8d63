"""Image directories. JPEG and PNG files, all JPEG before all PNG, then by path (a directory listing has no order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill.functions import expr


def scan(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(path, image_name, ext, ord) without reading contents; a limit of None or 0 means all."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").load(path).select("path")
    ext = F.element_at(F.split("path", r"\."), -1)
    rows = files.select("path", expr.stem(F.col("path")).alias("image_name"), ext.alias("ext"), F.when(ext == "jpg", 0).otherwise(1).alias("ord"))
    return rows.orderBy("ord", "path").limit(limit) if limit else rows


def decode(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """(origin, image_name, height, width, n_channels, mode, data): BGR rows; what can't be decoded has -1 everywhere."""
    rows = spark.read.format("image").option("pathGlobFilter", "*.{jpg,png}").option("dropInvalid", drop_invalid).load(path).select("image.*")
    return rows.select("origin", expr.stem(F.col("origin")).alias("image_name"), "height", "width", F.col("nChannels").alias("n_channels"), "mode", "data")
