"""Runs of repeated words: Lyndon roots from a stack scanned right to left, extended by verified longest common extensions.

A run is a maximal stretch of words with a smallest period q. For one of the two orders of the words (ascending, descending)
each of its Lyndon roots is the stretch from a word to the next lesser suffix, so two passes of a stack over the text, one
for each order, meet a root of every run in its first period. Suffixes are compared by their longest common extension (LCE):
prefix sums of a rolling hash are searched by doubling and halving, and what the hash says is verified word by word, from
which the exact extension follows whatever the hash did. A verified stretch is kept by its distance, so that words of a run
are verified once for each period and not once for each suffix. A root whose next period is equal is extended to both sides;
extents are exact, so a run found twice is the same triple. There is no suffix array, and memory is linear in the words.

Only stretches covered by repeated groups of five words can hold a run of `least` (6) words and four periods: such a run has
at least 2 q + 4 words, so each five words in it recur q words before or after, inside it. The stack runs over these stretches, and
finds the same runs as over the whole text: what extends a run keeps its period and lies in the same stretch.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, told apart by their characters (case counts); null and empty texts have no
words, no runs, and an empty collapsed text; runs come by start, then period, and may overlap; repeated rows get equal
results; an empty table gives an empty result; columns of the same names as new ones are replaced, others kept as they are.
Each text is one row's work, at its full length; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.llm.runtime import tidy

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE, _WHOLE = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Words in a group that must recur; runs have at least LEAST words and PERIODS periods, so 2 q + 4 words or more.
GRAM, LEAST, PERIODS = 5, 6, 4


class Extensions:
    """Exact longest common extensions of words, given as numbers."""

    def __init__(self, words: np.ndarray):
        self.array, self.words, self.n = words, words.tolist(), len(words)
        power = np.full(self.n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed * power[: self.n], out=sums[1:])
        self.power, self.sums = power.tolist(), sums.tolist()
        self.known: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, size: int) -> bool:
        s = self.sums
        return ((s[i + size] - s[i]) * self.power[j - i] - (s[j + size] - s[j])) & _WHOLE == 0

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        w, d = self.words, j - i
        at = self.known.get(d)
        if at and at[0] <= i <= at[1]:
            return at[1] - i
        top, size = self.n - j, 0
        while size < top and size < 4:
            if w[i + size] != w[j + size]:
                return size
            size += 1
        if at and i < at[0] <= i + size:
            self.known[d] = i, at[1]
            return at[1] - i
        step = 8
        while size < top and self._alike(i, j, min(step, top)):
            size, step = min(step, top), step * 2
        beyond = min(step, top + 1)
        while beyond - size > 1:
            middle = (size + beyond) // 2
            if self._alike(i, j, middle):
                size = middle
            else:
                beyond = middle
        size = self._verified(i, j, size, at)
        self.known[d] = i, i + size
        return size

    def _verified(self, i: int, j: int, size: int, at: tuple[int, int] | None) -> int:
        """`size`, or less if words differ before; what is known of this distance isn't looked at again."""
        to = min(size, at[0] - i) if at and i < at[0] else size
        differ = np.flatnonzero(self.array[i : i + to] != self.array[j : j + to])
        if len(differ):
            return int(differ[0])
        return at[1] - i if to < size else size

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        w, size = self.words, 0
        while size < i and size < 4:
            if w[i - size - 1] != w[j - size - 1]:
                return size
            size += 1
        low, step = size, 8
        while low < i and self._alike(i - min(step, i), j - min(step, i), min(step, i)):
            low, step = min(step, i), step * 2
        beyond = min(step, i + 1)
        while beyond - low > 1:
            middle = (low + beyond) // 2
            if self._alike(i - middle, j - middle, middle):
                low = middle
            else:
                beyond = middle
        differ = np.flatnonzero(self.array[i - low : i] != self.array[j - low : j])
        return low - 1 - int(differ[-1]) if len(differ) else low


def _found(words: np.ndarray, least: int, periods: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch, by the stack under both orders."""
    ext, n = Extensions(words), len(words)
    out: set[tuple[int, int, int]] = set()
    for sign in (1, -1):
        w = (sign * words).tolist()
        ext.known.clear()
        done: dict[int, tuple[int, int]] = {}  # by period the last run's start and the end of its roots
        stack: list[int] = []
        for i in range(n - 1, -1, -1):
            x, common = w[i], 0
            while stack:
                j = stack[-1]
                y = w[j]
                if y < x:
                    common = 0
                    break
                if y == x:
                    common = ext.right(i, j)
                    if j + common == n or w[j + common] < w[i + common]:
                        break
                    common = 0
                stack.pop()
            if common and stack:
                j = stack[-1]
                q = j - i
                if common >= q:
                    seen = done.get(q)
                    if not (seen and seen[0] <= i < seen[1]):
                        before = ext.left(i, j)
                        done[q] = i - before, i + common
                        length = before + common + q
                        if length >= max(least, periods * q):
                            out.add((i - before, length, q))
            stack.append(i)
    return out


def _covered(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of words that lie in a group of GRAM words that recurs; groups of equal hash count as equal."""
    if len(words) <= GRAM:
        return
    h = np.zeros(len(words) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = (h + words[i : i + len(h)].astype(np.uint64)) * np.uint64(_BASE)
        h ^= h >> np.uint64(31)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    recurs = np.zeros(len(h), bool)
    recurs[order[1:][same]] = recurs[order[:-1][same]] = True
    if not recurs.any():
        return
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(recurs)
    np.add.at(change, at, 1)
    np.add.at(change, at + GRAM, -1)
    inside = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    yield from zip(edges[::2].tolist(), edges[1::2].tolist())


def word_runs(words: list[str], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and `periods` periods, by start, then period."""
    if least < LEAST or periods < PERIODS:
        raise ValueError(f"runs of fewer than {LEAST} words or {PERIODS} periods are not covered")
    if len(words) < least:
        return []
    number: dict[str, int] = {}
    coded = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return []
    out = []
    for a, b in _covered(coded):
        if b - a >= least:
            out += [(a + start, length, q) for start, length, q in _found(coded[a:b], least, periods)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words outside of what follows the first period of any run, joined by a space."""
    out, at = [], 0
    for a, b in sorted((start + q, start + length) for start, length, q in runs):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return " ".join(out + words[at:])


def detect(df: DataFrame, text: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """df with runs, array of (start, length, period), and collapsed, the text with repetitions taken out."""
    new = ["runs", "collapsed"]
    kept = [c for c in df.columns if c not in new]
    place = kept.index(text)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*kept).dtypes)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short = [], []
            for value in batch.column(place):
                words = _WORD.findall(value.as_py() or "")
                runs = word_runs(words, least, periods)
                found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                short.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(short, pa.string())], [*kept, *new])

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(tidy(run), f"{fields}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): of documents whose h = crc32(doc_id) is divisible by 10, the words from a on repeat with period p.

    h counts the decimal doc_id as UTF-8; with g = h div 10 and n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    Texts without words, and rows with a null doc_id, stay as they are.
    """
    g = "(crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) div 10)"
    own = documents.select("doc_id", "text", F.expr("crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) % 10 = 0").alias("_chosen"), F.expr(g).alias("_g"))
    own = own.withColumn("_w", F.when(F.col("_chosen"), _words(F.col("text")))).withColumn("_n", F.size("_w"))
    own = own.withColumn("_a", F.expr("IF(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.expr("array_join(concat(slice(_w, 1, CAST(_a AS INT)), slice(flatten(array_repeat(slice(_w, CAST(_a AS INT) + 1, CAST(_p AS INT)), CAST((_n - _a) div _p + 1 AS INT))), 1, CAST(_n - _a AS INT))), ' ')")
    return own.select("doc_id", F.when(F.col("_chosen") & (F.col("_n") > 0), again).otherwise(F.col("text")).alias("text"))


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every document."""
    found = detect(planted(documents))
    first = F.expr("reduce(runs, CAST(NULL AS struct<start: long, length: long, period: long>), (b, r) -> IF(b IS NULL OR r.length > b.length, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("_top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * _top.length div _top.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "_top.start", "_top.length", "_top.period", milli, "runs_sha256", "collapsed_sha256")
