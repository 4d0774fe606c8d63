"""Length buckets whose bounds minimise padding, by dynamic programming over the global histogram; batches by token budget.

1. The histogram of all documents' lengths, exact, comes to the driver: a row for each length that occurs. Texts of m
   different lengths have m * m / 2 tokens at least, so the rows are at most the square root of twice all tokens, and at most
   the greatest length.
2. best[j] over k buckets = min over i of best[i] over k - 1 + (documents of lengths i..j) * (greatest length) - (their sum):
   bounds that pad least among all choices of at most `buckets` bounds. Each i is a line in the greatest length, and the
   lines of the lower envelope are met in order, so a bucket costs one pass over the histogram.
3. In each bucket documents are numbered without a gap in the order of a hash, and every floor(budget / bound) of them (at
   least one) make a batch: a batch never has more than `budget` tokens, padding included, unless it is one longer document.

Tokens are white-space words, or those of a vocabulary file where one is given.

Defined results: null, empty or wordless text has 0 tokens; documents longer than the budget stay whole, one to a batch;
repeated rows have places of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm import textkit, tokens
from terraquill.llm.runtime import numbered, tidy, with_places


def lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens): runs without white space in each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(textkit.word_counts(batch.column(1)), pa.int64())], [key, "n_tokens"])

    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(tidy(run), f"`{key}` {dict(df.dtypes)[key]}, n_tokens long")


def bounds(length: list[int], count: list[int], buckets: int) -> tuple[list[int], int]:
    """The lengths that end a bucket, and the padding, for lengths in ascending order and their counts."""
    m = len(length)
    c, s = [0, *accumulate(count)], [0, *accumulate(n * x for n, x in zip(count, length))]
    best: list[int | None] = [0] + [None] * m
    back = []
    for _ in range(min(buckets, m)):
        now, cut = best.copy(), [-1] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i) of the lower envelope, slopes descending
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                slope, height = -c[j - 1], best[j - 1] + s[j - 1]
                while len(hull) > 1 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, height, j - 1))
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = length[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            cost = hull[at][0] * x + hull[at][1] + c[j] * x - s[j]
            if now[j] is None or cost < now[j]:
                now[j], cut[j] = cost, hull[at][2]
        back.append(cut)
        best = now
    out, j = [], m
    for cut in reversed(back):
        if cut[j] >= 0:
            out.append(length[j - 1])
            j = cut[j]
    return out[::-1], best[m]


def pack(df: DataFrame, key: str, length: str, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """(key, length, bucket, bucket_len, batch, place, padding), a row for each row of df; null lengths count as 0."""
    rows, n = with_places(df.select(key, F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("_n")))
    found = rows.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).toPandas().sort_values("_n")
    ends = bounds(found["_n"].tolist(), found["_c"].tolist(), buckets)[0] if len(found) else [0]
    bound = F.array(*[F.lit(x).cast("long") for x in ends])
    rows = rows.withColumn("bucket", F.size(F.filter(bound, lambda x: x < F.col("_n"))).cast("int"))
    rows = rows.withColumn("bucket_len", F.element_at(bound, F.col("bucket") + 1))
    rows = numbered(rows.withColumn("_h", F.xxhash64(key)), ["bucket"], ["_h", key], "_i", n)
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    return rows.select(
        key, F.col("_n").alias(length), "bucket", "bucket_len", F.floor(F.col("_i") / each).cast("long").alias("batch"),
        (F.col("_i") % each).cast("long").alias("place"), (F.col("bucket_len") - F.col("_n")).alias("padding"),
    )


def pack_documents(documents: DataFrame, buckets: int = 16, budget: int = 65536, vocabulary: str | None = None, nodes: int = tokens.NODES) -> DataFrame:
    """`pack` of the documents by their white-space words, or by the tokens of a vocabulary file (see `tokens`, also for nodes)."""
    counts = tokens.count(documents.select("doc_id", "text"), "text", vocabulary, nodes).drop("n_words") if vocabulary else lengths(documents, "doc_id", "text")
    return pack(counts, "doc_id", "n_tokens", buckets, budget)
