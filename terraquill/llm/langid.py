"""Language ID by rank-order profiles: out-of-place distance between a document's most frequent n-grams and a language's.

A text is lower-cased, every run of characters that are not letters becomes one space, and the counts of its 1- to
3-character n-grams (a space marks word ends) are ranked, most frequent first, ties to the smaller code. The distance to
a language sums, over the document's first `size` n-grams, how far each is from its rank in the language's profile, or
`size` if it isn't there. The nearest language wins, ties to the smaller name. The score is 1 less the distance divided
by its possible maximum.

A language's profile ranks the n-gram counts of its training rows: those whose crc32(doc_id as text) mod 5 is not 0, with
text and language. Of each language about `rows` training rows, chosen by a hash, are counted: the documented bound of the
fit. Prediction takes whole texts of all rows and needs no shuffle; the profiles (size x languages) are broadcast. More
than MOST languages, as in a column that holds something else, are an error and not gathered.

Defined results: null text or text without a letter is `und` with score 0, and so is everything if there is nothing to
learn from; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquill.llm.runtime import tidy

_PIECE = 1 << 19
MOST = 4096
_letters: list[np.ndarray] = []


def _letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, as 21 bits a character, ascending, and their counts."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = (text or "").lower()
    tail = np.array([32], np.int64)
    for at in range(0, len(text), _PIECE):
        x = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        x = np.where(_letter()[x], x, 32)
        last = at + _PIECE >= len(text)
        x = np.concatenate([tail, x, [32]] if last else [tail, x])
        space = x == 32
        keep = np.ones(len(x), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        x = x[keep]
        old = len(tail)
        one = x[old:]
        two = (x[:-1] << 21 | x[1:])[max(0, old - 1) :]
        three = x[:-2] << 42 | x[1:-1] << 21 | x[2:]
        g = np.sort(np.concatenate([one[one != 32], two, three]))
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        g, c = g[first], np.diff(np.concatenate([first, [len(g)]]))
        if len(grams):
            both = np.concatenate([grams, g])
            grams, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, c]), len(grams)).astype(np.int64)
        else:
            grams, counts = g, c
        tail = x[-2:]
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller code."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """Ranks of the n-grams of each language."""

    def __init__(self, ranks: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(ranks)
        self.grams = [np.sort(np.array(ranks[x], np.int64)) for x in self.names]
        self.ranks = [np.argsort(np.array(ranks[x], np.int64), kind="stable") for x in self.names]

    def nearest(self, text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text)
        if not self.names or not len(grams) or not np.any(grams < 1 << 21):
            return "und", 0.0
        own = ranked(grams, counts, self.size)
        at, best = np.arange(len(own)), None
        for name, there, ranks in zip(self.names, self.grams, self.ranks):
            if len(there):
                i = np.minimum(np.searchsorted(there, own), len(there) - 1)
                away = int(np.where(there[i] == own, np.minimum(np.abs(ranks[i] - at), self.size), self.size).sum())
            else:
                away = self.size * len(own)
            if best is None or away < best[0]:
                best = away, name
        return best[1], 1 - best[0] / (self.size * len(own))


def learn(training: DataFrame, text: str, lang: str, size: int = 400, rows: int = 2000) -> Profiles:
    """The profiles of rows that have text and language; of each language about `rows` rows are counted.

    Rows are chosen by a hash of all columns of `training`: with an id among them, copies of a text are chosen one by one.
    """
    known = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).withColumn("_pick", F.pmod(F.xxhash64(*training.columns), F.lit(1 << 30)))
    sizes = known.groupBy(F.col(lang).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_k", F.least(F.lit(1 << 30), F.floor(F.lit(float(1 << 30) * rows) / F.col("_n"))).cast("long").alias("_below"))
    there = sizes.limit(MOST + 1).collect()
    if len(there) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not there:
        return Profiles({}, size)
    below = F.broadcast(training.sparkSession.createDataFrame(there, sizes.schema))
    picked = known.join(below, F.col(lang) == F.col("_k")).where("_pick < _below")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(k, []).append(gram_counts(t.as_py()))
            for k, parts in held.items():
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts)], ["lang", "gram", "n"])

    counted = picked.select(F.col(lang).cast("string").alias("lang"), text).mapInArrow(tidy(count), "lang string, gram long, n long")
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    ranks: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "r").select("lang", "gram").collect():
        ranks.setdefault(r[0], []).append(r[1])
    return Profiles(ranks, size)


def predict(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """df with `lang_pred` (string) and `score` (double, 0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    place = kept.index(text)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.nearest(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*kept, "lang_pred", "score"])

    return df.select(*kept).mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")


def fold(doc_id: str, of: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def identify(documents: DataFrame, size: int = 400, rows: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document; learned from rows that aren't held out."""
    out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    profiles = learn(documents.where(~out).select("doc_id", "text", "lang"), "text", "lang", size, rows)
    return predict(documents.select("doc_id", out.alias("held_out"), "text"), profiles).drop("text")
