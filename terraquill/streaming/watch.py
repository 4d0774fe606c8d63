"""An extension: an image directory as a stream, each new file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraquill.functions import expr


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_name, length) of files as they appear; contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{jpg,png}").load(path)
    return rows.select("path", expr.stem(F.col("path")).alias("image_name"), "length")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to a Parquet folder and stops; the checkpoint makes it exactly once."""
    return files(spark, path).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
