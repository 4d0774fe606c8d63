"""Quality scores: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model on them.

The indicators of a text are its distinct 1- to 3-byte n-grams (of UTF-8), hashed to BUCKETS, and its word n-grams up to SAME
words by their form, of which the one of n equal words (A-Z as a-z) counts, with a bucket of its own for each n from 2. The
log-count ratio of a bucket compares how often it occurs in texts of either class; all labelled training rows are counted.
Indicators times ratios, at unit length, are the features of a support vector machine with hinge loss, fitted by dual
coordinate descent (multipliers from 0 to the cost). The fit takes a bounded sample: of each class at most half of `rows`
training rows, drawn by a hash of the row so that about half of `nbytes` of text is not exceeded; a class with fewer rows is
whole, and each class weighs the root of its number of rows. The score is the logistic of twice the margin. Scoring reads
each whole text once, with one weight a bucket broadcast, and shuffles nothing.

Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1. Several labels of one id count as the greatest; null
labels don't count. If a class is missing, all scores are that of the class that is there, or 0.5 without any.

Defined results: null and empty texts have no indicator and get the score of the bias; repeated rows get equal scores; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm import textkit
from terraquill.llm.runtime import lookup_join, tidy

BUCKETS = 1 << 17
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
#: Most equal words in a row that have an indicator of their own, and the number of all indicators.
SAME = 24
WIDTH = BUCKETS + SAME - 1


def _grams(data: np.ndarray) -> list[np.ndarray]:
    b = data.astype(np.uint32)
    shift = np.uint32(32 - 17)
    one = (b + np.uint32(1)) * _MIX[0] >> shift
    two = ((b[:-1] << np.uint32(8) | b[1:]) + np.uint32(1 << 9)) * _MIX[1] >> shift
    three = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) + np.uint32(1 << 25)) * _MIX[2] >> shift
    return [one, two, three]


def bucket_of(gram: bytes) -> int:
    """Of one byte n-gram."""
    return int(_grams(np.frombuffer(gram, np.uint8))[len(gram) - 1][0])


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row the buckets of its indicators, ascending."""
    for (lo, hi, data, offsets), (*_, h, places) in zip(textkit.chunks(column), textkit.words(column)):
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        seen = np.zeros(WIDTH, bool)
        one, two, three = _grams(data) if len(data) <= textkit.CHUNK else (None,) * 3
        for r in range(hi - lo):
            a, b = int(offsets[r]), int(offsets[r + 1])
            if one is not None:
                seen[one[a:b]] = True
                seen[two[a : max(a, b - 1)]] = True
                seen[three[a : max(a, b - 2)]] = True
            else:
                for at in range(a, b, textkit.CHUNK):
                    for g in _grams(data[at : min(b, at + textkit.CHUNK + 2)]):
                        seen[g] = True
            same = again[places[r] + 1 : places[r + 1]]
            if same.any():
                breaks = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
                seen[BUCKETS : BUCKETS + min(SAME, int(np.diff(breaks).max())) - 1] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found.astype(np.int32)


def _counts(training: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of class 0 and 1 have each indicator; (y, text) in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, WIDTH), np.int64)
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), indicators(batch.column(1))):
                held[y, x] += 1
        there = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(held[0, there]), pa.array(held[1, there])], ["bucket", "c0", "c1"])

    counted = training.mapInArrow(tidy(run), "bucket int, c0 long, c1 long").groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()
    out = np.zeros((2, WIDTH))
    out[0, counted["bucket"]], out[1, counted["bucket"]] = counted["c0"], counted["c1"]
    return out[0], out[1]


def log_count_ratios(c0: np.ndarray, c1: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = c1 + smooth, c0 + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights of a linear model with hinge loss on unit rows of scaled indicators, the bias last; cost: of each row's loss."""
    w = np.zeros(len(scale) + 1)
    values = [scale[x] / max(1e-12, float(np.sqrt(np.square(scale[x]).sum()))) for x in rows]
    squares = np.array([float(np.square(v).sum()) for v in values]) + 1.0
    alpha = np.zeros(len(rows))
    order = np.arange(len(rows))
    shuffle = np.random.default_rng(seed)
    for _ in range(rounds):
        shuffle.shuffle(order)
        worst = 0.0
        for i in order.tolist():
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + w[-1]) - 1
            now = min(max(alpha[i] - slope / squares[i], 0.0), cost[i])
            if now != alpha[i]:
                worst = max(worst, abs(now - alpha[i]))
                d = (now - alpha[i]) * y[i]
                w[x] += d * v
                w[-1] += d
                alpha[i] = now
        if worst < 1e-4:
            break
    return w


class Model:
    def __init__(self, scale: np.ndarray, weights: np.ndarray):
        self.scale, self.combined, self.bias = scale, scale * weights[:-1], float(weights[-1])

    def score(self, x: np.ndarray) -> float:
        own = self.scale[x]
        length = float(np.sqrt(np.square(own).sum()))
        margin = self.bias + (float(self.combined[x].sum()) / length if length > 0 else 0.0)
        return float(1 / (1 + np.exp(-np.clip(2 * margin, -500, 500))))


def learn(training: DataFrame, rows: int = 8000, nbytes: int = 48 << 20, cost: float = 4.0) -> Model:
    """training: (y, text, ...), y 0 or 1. Every row is counted; of each class a hashed sample within both bounds is fitted.

    Rows are drawn by a hash of all columns: with an id among them, copies of a text and null texts are drawn one by one.
    """
    c0, c1 = _counts(training)
    n, size = {0: 0, 1: 0}, {}
    for y, count, held in training.groupBy("y").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).collect():
        n[y], size[y] = count, held or 0
    flat = np.zeros(WIDTH + 1)
    if not n[0] or not n[1]:
        flat[-1] = 250.0 if n[1] else -250.0 if n[0] else 0.0
        return Model(np.zeros(WIDTH), flat)
    most = max(1, rows // 2)
    # Somewhat more than the share is drawn, and what is too much is cut off in the order of the hash.
    share = {y: min(1.0, (most + 6 * most**0.5) / n[y], nbytes / 2 / max(1, size[y])) for y in n}
    h = F.pmod(F.xxhash64(*training.columns), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in indicators(batch.column(2))], pa.binary())], ["y", "h", "x"])

    held, labels = [], []
    for y in (0, 1):
        drawn = training.where((F.col("y") == y) & (h < int(share[y] * (1 << 30)))).select("y", h.alias("h"), "text")
        own = drawn.mapInArrow(tidy(run), "y int, h long, x binary").orderBy("h", "x").limit(most).toPandas()
        held += [np.frombuffer(x, np.int32) for x in own["x"]]
        labels += [2.0 * y - 1] * len(own)
    y = np.array(labels)
    if len(set(labels)) < 2:
        flat[:-1] = 1.0
        return Model(log_count_ratios(c0, c1), flat)
    weight = {v: n[v] ** 0.5 / max(1, int((y == 2 * v - 1).sum())) for v in n}
    each = np.where(y > 0, weight[1], weight[0])
    scale = log_count_ratios(c0, c1)
    return Model(scale, dual_coordinate_descent(held, y, scale, cost * each / each.mean()))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without its text, with score (double) and predicted (int)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (text, "score", "predicted")]
    fields = "".join(f"`{c}` {t}, " for c, t in df.dtypes if c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([shared.value.score(x) for x in indicators(batch.column(len(kept)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return df.select(*kept, text).mapInArrow(tidy(run), f"{fields}score double, predicted int")


def assess(documents: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; learned from labelled rows that aren't held out."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.where(F.col("quality").isin(0, 1) & ~out).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    training = lookup_join(documents.where(~out).select("doc_id", "text"), known, "doc_id").select("y", "text", "doc_id")
    return score(documents.select("doc_id", out.alias("held_out"), "text"), learn(training, **bounds))
