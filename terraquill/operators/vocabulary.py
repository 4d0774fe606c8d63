"""Which terms of vocabularies occur in texts: one pass over a text finds all terms of all vocabularies.

A vocabulary is a table of (vocabulary, term, ord). Its terms become one Aho-Corasick automaton, which the tasks build from
the broadcast terms and run over each text once, whatever the number of terms. The table's size is counted first: beyond
MOST_BYTES of terms it is dealt by a hash to several automata, each broadcast and run alone, and between their passes the rows are
kept in the shared folder, so a task never holds more than one automaton.

A term occurs where it is a substring of the lower-cased text; each counts once, terms inside other terms too. An empty term
occurs in every text. Null texts have no hits (null counts), null terms are none; a term repeated in a vocabulary counts once,
with its least ord.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill import vocab
from terraquill.operators.shared import cut

#: Bytes of terms in one automaton; it takes some forty times as much memory.
MOST_BYTES = 8 << 20
HITS = "array<struct<vocabulary: string, ord: long, term: string>>"


def of_lists(spark: SparkSession, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(name, t, i) for name, terms in lists.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "vocabulary string, term string, ord long")


def captions_vocabulary(spark: SparkSession) -> DataFrame:
    """The three vocabularies of caption quality."""
    return of_lists(spark, {"keywords": vocab.AERIAL_KEYWORDS, "spatial": vocab.SPATIAL_TERMS, "structures": vocab.STRUCTURE_TERMS})


def automaton(terms: list[tuple[str, int, str]]) -> tuple[ahocorasick.Automaton, list[tuple[str, int, str]]]:
    """An automaton over (vocabulary, ord, term), and what every text has."""
    uses: dict[str, list[tuple[str, int, str]]] = {}
    for t in terms:
        uses.setdefault(t[2], []).append(t)
    made = ahocorasick.Automaton()
    for term, own in uses.items():
        if term:
            made.add_word(term, own)
    made.make_automaton()
    return made, uses.get("", [])


def _found(df: DataFrame, terms: list[tuple[str, int, str]], lowered: str, out: str) -> DataFrame:
    """df with the terms of `out` and those that occur in `lowered`, by vocabulary and ord."""
    shared = df.sparkSession.sparkContext.broadcast(terms)
    names = df.columns
    place, had = names.index(lowered), names.index(out)
    kind = pa.list_(pa.struct([("vocabulary", pa.string()), ("ord", pa.int64()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, always = automaton(shared.value)
        runs = made.iter if len(made) else lambda text: ()
        for batch in batches:
            found = []
            for text, old in zip(batch.column(place), batch.column(had)):
                text = text.as_py()
                if text is None:
                    found.append(None)
                    continue
                seen: set[str] = set()
                hits = [(x["vocabulary"], x["ord"], x["term"]) for x in old.as_py() or ()] + always
                for _, own in runs(text):
                    if own[0][2] not in seen:
                        seen.add(own[0][2])
                        hits += own
                found.append([{"vocabulary": v, "ord": i, "term": t} for v, i, t in sorted(hits)])
            columns = [*batch.columns]
            columns[had] = pa.array(found, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def with_hits(df: DataFrame, text: Column, vocabulary: DataFrame, out: str = "hits", most_bytes: int = MOST_BYTES) -> DataFrame:
    """df with `out`, an array of (vocabulary, ord, term): the terms that occur in the text, by vocabulary and ord."""
    terms = vocabulary.where("term IS NOT NULL").groupBy(F.col("vocabulary"), F.col("term")).agg(F.min(F.col("ord").cast("long")).alias("ord"))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 1), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_bytes))
    rows = df.withColumn(out, F.lit(None).cast(HITS)).withColumn("_low", F.lower(text))
    for i in range(parts):
        own = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i)
        rows = _found(rows, [(r["vocabulary"], r["ord"], r["term"]) for r in own.collect()], "_low", out)
        rows = cut(rows) if i + 1 < parts else rows
    return rows.drop("_low")


def hits_of(hits: Column, vocabulary: str) -> Column:
    """The terms of one vocabulary, in its order."""
    return F.transform(F.filter(hits, lambda h: h["vocabulary"] == vocabulary), lambda h: h["term"])


def hit_count(hits: Column, vocabulary: str) -> Column:
    return F.size(hits_of(hits, vocabulary)).cast("long")
