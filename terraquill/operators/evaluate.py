"""Caption evaluation: quality of each caption, averages and rank of each model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquill import vocab
from terraquill.functions import expr
from terraquill.operators import vocabulary
from terraquill.operators.ordinal import numbered

#: Observations in one row of a report.
CHUNK_ROWS = 1000
#: Doubles are added as decimals of this kind: their sums don't depend on the order or the number of tasks.
EXACT = "decimal(38,18)"


def quality(captions: DataFrame) -> DataFrame:
    """captions with word_count, number_count, length, quantification, spatial, structures, overall, keyword_count.

    One pass over a caption finds the terms of all three vocabularies.
    """
    rows = vocabulary.with_hits(captions, F.col("caption"), vocabulary.captions_vocabulary(captions.sparkSession), "_hits")
    n = lambda name: vocabulary.hit_count(F.col("_hits"), name)
    rows = rows.withColumn("word_count", expr.word_count(F.col("caption"))).withColumn("number_count", expr.number_count(F.col("caption")))
    rows = rows.withColumn("length", expr.length_score(F.col("word_count"))).withColumn("quantification", expr.share(F.col("number_count"), 3))
    rows = rows.withColumn("spatial", expr.share(n("spatial"), 3)).withColumn("structures", expr.share(n("structures"), 4))
    rows = rows.withColumn("overall", expr.overall(*map(F.col, ("length", "quantification", "spatial", "structures"))))
    return rows.withColumn("keyword_count", n("keywords")).drop("_hits")


def observations(captions: DataFrame) -> DataFrame:
    """Quality rows as the benchmark keeps them: an error has time, quality and keywords 0, and no partial scores."""
    rows = quality(captions)
    bad = F.col("is_error")
    for c in ("length", "quantification", "spatial", "structures"):
        rows = rows.withColumn(c, F.when(~bad, F.col(c)))
    for c, zero in (("inference_time", F.lit(0.0)), ("overall", F.lit(0.0)), ("keyword_count", F.lit(0).cast("long"))):
        rows = rows.withColumn(c, F.when(bad, zero).otherwise(F.col(c)))
    return rows


def models_table(spark) -> DataFrame:
    rows = [(i, m.key, m.name, m.memory_gb) for i, m in enumerate(vocab.MODELS)]
    return spark.createDataFrame(rows, "model_ord long, model string, model_name string, memory_gb double")


_SUMS = {"inference_time": "time_sum", "overall": "quality_sum", "keyword_count": "keywords_sum"}


def partial(seen: DataFrame) -> DataFrame:
    """(model_key, is_error, n_rows, time_sum, quality_sum, keywords_sum): exact sums that batches can be merged by.

    A value counts as the shortest decimal that gives its double, to 18 places, so sums are the same in any order; nulls
    count as no value in n_<sum>. Values beyond 10^19 or that are no number are an error of the batch, not a wrong mean.
    """
    sums = [e for c, s in _SUMS.items() for e in (F.coalesce(F.sum(F.col(c).cast(EXACT)), F.lit(0).cast(EXACT)).cast(EXACT).alias(s), F.count(c).alias(f"n_{s}"))]
    return seen.groupBy("model_key", "is_error").agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def merged(*states: DataFrame) -> DataFrame:
    """One state of several; rows equal in model and is_error are added."""
    all_of = states[0]
    for s in states[1:]:
        all_of = all_of.unionByName(s)
    names = [n for n in all_of.columns if n not in ("model_key", "is_error")]
    return all_of.groupBy("model_key", "is_error").agg(*(F.sum(n).cast(dict(all_of.dtypes)[n]).alias(n) for n in names))


def add_batch(folder: str, batch: str, seen: DataFrame) -> DataFrame:
    """Adds a batch of observations to the state kept in `folder`, and returns the state of all batches.

    A batch's sums are a few rows in a folder of its own; a batch that is added again replaces itself, so a repeated or
    restarted job counts nothing twice. Earlier batches' observations are not read.
    """
    partial(seen).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")
    return stored_state(seen.sparkSession, folder)


def stored_state(spark, folder: str) -> DataFrame:
    """The merged state of all batches in a folder."""
    return merged(spark.read.parquet(folder.rstrip("/")).drop("batch"))


def summary_of(state: DataFrame, failed: tuple[str, ...] = (), count_errors: bool = True) -> DataFrame:
    """Averages and combined score of each model that didn't fail, of a state; with count_errors, errors weigh as zeros.

    The models are a fixed list of four, so their table is broadcast.
    """
    rows = state if count_errors else state.where("NOT is_error")
    rows = merged(rows.withColumn("is_error", F.lit(False)))
    rows = rows.where(~F.col("model_key").isin(*failed)) if failed else rows
    mean = lambda s: F.when(F.col(f"n_{s}") > 0, F.col(s).cast("double") / F.col(f"n_{s}")).otherwise(F.lit(0.0))
    means = rows.select("model_key", mean("time_sum").alias("avg_time_s"), mean("quality_sum").alias("avg_quality"), mean("keywords_sum").alias("avg_keywords"))
    out = means.join(F.broadcast(models_table(state.sparkSession)), F.col("model_key") == F.col("model"))
    return out.select("model_ord", "model", "model_name", "memory_gb", "avg_time_s", "avg_quality", "avg_keywords", expr.combined_score(*map(F.col, ("avg_quality", "avg_keywords", "avg_time_s"))).alias("combined_score"))


def summary(seen: DataFrame, failed: tuple[str, ...] = (), count_errors: bool = True) -> DataFrame:
    """summary_of all observations at once."""
    return summary_of(partial(seen), failed, count_errors)


def ranking(summarised: DataFrame) -> DataFrame:
    """Ranks by combined score; ties keep the order of the models. One row for each model, so one task is enough."""
    order = W.orderBy(F.desc("combined_score"), "model_ord")
    return summarised.withColumn("rank", F.row_number().over(order).cast("long"))


def best(summarised: DataFrame) -> DataFrame:
    return summarised.orderBy(F.desc("combined_score"), "model_ord").limit(1)


def report(seen: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(model_key, chunk_no, first, n_images, results): a model's observations in image order, `chunk` of them to a row.

    Chunks of a model, joined by commas in order, are its whole list; no row and no task holds more than a chunk's rows or a
    block's. first is the place of a chunk's first observation, from 0.
    """
    item = F.concat_ws(":", F.col("image_id").cast("string"), F.col("keyword_count").cast("string"), F.col("word_count").cast("string"))
    rows = numbered(seen.select("model_key", "image_id", item.alias("t")), ["model_key"], ["image_id"], "_at")
    rows = rows.withColumn("chunk_no", F.expr(f"(_at - 1) div {chunk}"))
    each = rows.groupBy("model_key", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("_at", "t"))).alias("l"))
    return each.select("model_key", "chunk_no", (F.col("chunk_no") * chunk).alias("first"), F.size("l").cast("long").alias("n_images"), F.array_join(F.transform("l", lambda x: x["t"]), ",").alias("results"))
