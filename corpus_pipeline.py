"""From raw documents to packed training batches: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
they are called: where one has the name of a column that an operator makes, it keeps its own values. `run` writes each
stage's rows as Parquet in the shared folder, reads them again as the next one's docs, and deletes them when the next one's
are written. Stages keep rows whole: only what a docstring names goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill.llm import decontam, jaccard, langid, packing, pii, tokens
from terraquill.llm.runtime import counted, cut, discard, lookup_join, new_folder, small_batches, stored, table


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with other names for columns that are called so, and what selects all columns by their own names."""
    taken = {n.lower() for n in names}
    other = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    return docs.withColumnsRenamed(other), [F.col(other.get(c, c)).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (null or empty text, no letter); `lang` becomes the predicted language
    where it is null.

    It stays null where the text shares no n-gram with any profile (score 0): the nearest language is then no finding.
    Repeated rows share their fate; an empty table stays empty.
    """
    small_batches(spark)
    profiles = langid.learn(docs.select("doc_id", "text", "lang"), "text", "lang")
    renamed, own = _aside(docs, "lang_pred", "score")
    found = langid.predict(renamed, profiles).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", F.when(F.col("score") > 0, F.col("lang_pred")))).select(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group linked at 0.8 on five-word shingles the row of the least id, and every row that stands alone.

    Each row is decided alone: rows that repeat an id don't share a fate, and a null id counts as greater than all others.
    Of exact repetitions with an id one stays, whatever types the columns have (rows are told apart by a digest).
    """
    ids = docs.select("doc_id")
    twice, state = counted(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"))
    if not state.rows:
        linked, state = counted(jaccard.link(docs, k=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct())
        return lookup_join(docs, linked, "doc_id", "left_anti", state.rows).select(docs.columns)
    # Ids don't tell rows apart here: rows get keys, stored with them so that every later reading sees the same.
    renamed, own = _aside(docs, "_key", "_first", "_group", "n", "_same")
    rows = stored(renamed.withColumn("_key", F.monotonically_increasing_id()))
    linked = jaccard.link(rows, k=5, percent=80, doc_id="_key").select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group"))
    placed = cut(rows.select("_key", "doc_id").join(linked, "_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).getField("_key")
    groups = cut(placed.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), first.alias("_first")).where("n > 1"))
    gone = cut(lookup_join(placed, groups, "_group").where("_key <> _first").select("_key"))
    kept = lookup_join(rows, gone, "_key", "left_anti")
    once = lookup_join(kept, twice, "doc_id", "left_anti", state.rows)
    repeated = lookup_join(kept, twice, "doc_id", "left_semi", state.rows)
    same = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in renamed.columns))), 256)
    return once.select(own).union(repeated.withColumn("_same", same).dropDuplicates(["_same"]).select(own))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose own text holds at least 80 percent of a test item's five-word shingles, with whatever id or none.

    Null, empty and wordless texts hold nothing and stay; repeated rows share their fate.
    """
    return decontam.without(docs, table(spark, sf_dir, "benchmark"), k=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind; n_chars becomes the masked text's length where text was masked.

    All rows stay. Null and empty texts stay as they are; repeated rows stay equal.
    """
    renamed, own = _aside(docs, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked")
    found = pii.scan(renamed)
    changed = ~F.col("text").eqNullSafe(F.col("masked"))
    out = found.withColumn("n_chars", F.when(changed, F.char_length("masked").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("masked")).select(own)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its tokens, bucket, batch, place and padding. Null and empty texts have 0 tokens; repeated rows
    have places of their own."""
    return packing.pack_documents(docs, vocabulary=tokens.VOCABULARY, nodes=200_000)  # by the memory that earlier stages leave


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("packing", pack_batches),
]

#: No SQL: rank-order profiles, the semi-Markov field and the bucket programme are beyond it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents and returns the last one's rows."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, last)
        docs, last = spark.read.parquet(path), [path]
    return docs
