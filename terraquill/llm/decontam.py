"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is the set of its distinct k-word shingles (words: lower-cased runs of letters and digits), of which a document
must hold at least `percent` in a hundred. Items are partitioned by size, as items are short and documents long: Jaccard
similarity says nothing there, and the number of minimal hashes that is enough depends on the item's size alone. An item
of s shingles may miss at most s - ceil(s * percent / 100) of them, so of its s - ceil(...) + HITS smallest hashes (its
MinHash sketch) a document that holds it has at least HITS. Each partition is one sorted table of its items' sketches, whose
greatest hash is the partition's bound; a document's own sketch there is made of all its hashes up to that bound, so it is
as long as the document needs and neither side's size spoils the other's. Candidates share HITS sketch hashes (or as many
as the item's sketch can demand), and are then tested by exact shingle containment. No item is missed.

Documents are read once per block of items, never shuffled. Items are dealt by a hash to as many blocks as make about
BLOCK_SHINGLES shingles each, counted first by the items' own words; a block is broadcast. One item is never split.

Defined results: items or documents that are null or have no word match nothing; an item of fewer than k words is one
shingle, its whole sequence, and matches where these words stand in a row; repeated rows match each; empty tables give an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm import textkit
from terraquill.llm.runtime import tidy

HITS = 3
BLOCK_SHINGLES = 1_000_000
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def lower(texts: pa.Array) -> pa.Array:
    """Character by character, for documents and items alike: str.lower looks at a capital sigma's place and makes two of İ."""
    return pc.utf8_lower(texts)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower(pa.array([text or ""]))[0].as_py())


def item_shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


class Sketches:
    """Sketches of a block of items by partition, and their exact shingles."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int):
        self.k, self.percent = k, percent
        self.exact = [(i, s) for i, t in items if (s := item_shingles(t, k))]
        self.partitions: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        held: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for number, (_, s) in enumerate(self.exact):
            width = len(next(iter(s)))
            hashes = np.sort(np.array([self._hash(x) for x in s], np.uint64))
            spare = len(s) - -(-percent * len(s) // 100)
            need = min(HITS, len(s) - spare)
            for h in hashes[: spare + need].tolist():
                held.setdefault((width, len(s).bit_length()), []).append((h, number))
        self.need = np.array([min(HITS, -(-percent * len(s) // 100)) for _, s in self.exact])
        for (width, _), pairs in sorted(held.items()):
            pairs.sort()
            h = np.array([x for x, _ in pairs], np.uint64)
            table = np.zeros(1 << 16, bool)
            table[(h >> np.uint64(3)) & np.uint64(0xFFFF)] = True
            self.partitions.append((width, h, np.array([x for _, x in pairs]), table))
        self.widths = sorted({w for w, *_ in self.partitions})

    @staticmethod
    def _hash(shingle: tuple[str, ...]) -> int:
        _, _, h, offsets = next(textkit.words(pa.array([" ".join(shingle)]), textkit.NOT_ALNUM))
        return int(next(textkit.shingles(h, offsets, len(shingle)))[0])

    def candidates(self, h: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(row, item number) of a chunk's rows that hold enough of an item's sketch."""
        out: list[tuple[int, int]] = []
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for width in self.widths:
            n = max(0, len(h) - width + 1)
            x = np.zeros(n, np.uint64)
            for i in range(width):
                x = textkit.mix(x + h[i : i + n] + np.uint64(i + 1))
            whole = row_of[:n] == row_of[width - 1 :] if n else np.zeros(0, bool)
            for own, hashes, numbers, table in self.partitions:
                if own != width or not n:
                    continue
                maybe = np.flatnonzero(table[(x >> np.uint64(3)) & np.uint64(0xFFFF)] & whole & (x <= hashes[-1]))
                lo, hi = np.searchsorted(hashes, x[maybe]), np.searchsorted(hashes, x[maybe], "right")
                maybe, lo, hi = maybe[lo < hi], lo[lo < hi], hi[lo < hi]
                if not len(maybe):
                    continue
                times = hi - lo
                place = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                hit = np.unique(np.stack([np.repeat(row_of[maybe], times), numbers[place], np.repeat(x[maybe].view(np.int64), times)]), axis=1)
                pairs, counts = np.unique(hit[:2], axis=1, return_counts=True)
                good = counts >= self.need[pairs[1]]
                out += zip(pairs[0][good].tolist(), pairs[1][good].tolist())
        return out


def _found(known: Sketches, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shared shingles, the item's shingles) of the texts that hold an item."""
    lowered = lower(texts)
    for lo, _, h, offsets in textkit.words(lowered, textkit.NOT_ALNUM):
        last, have = None, {}
        for row, number in sorted(known.candidates(h, offsets)):
            item, s = known.exact[number]
            width = len(next(iter(s)))
            if row != last:
                w, have, last = _WORD.findall(lowered[lo + row].as_py()), {}, row
            if width not in have:
                have[width] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
            shared_count = len(s & have[width])
            if 100 * shared_count >= known.percent * len(s):
                yield lo + row, item, shared_count, len(s)


def _search(docs: DataFrame, sketches: Sketches) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_found(shared.value, batch.column(1)))
            if found:
                rows, items, hits, sizes = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(items, pa.int64()), pa.array(hits, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])

    return docs.mapInArrow(tidy(run), "doc_id long, item_id long, n_shared long, n_item long")


def _blocks(benchmark: DataFrame, k: int, percent: int, block: int) -> Iterator[Sketches]:
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # Words, counted by the pattern that items are cut by, are at least as many as shingles.
    size = F.regexp_count(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    blocks = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield Sketches([tuple(r) for r in dealt.where(F.col("block") == b).select("item_id", "text").collect()], k, percent)


def contained(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document that holds `percent` of an item's shingles."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for sketches in _blocks(benchmark, k, percent, block):
        own = _search(docs, sketches)
        out = own if out is None else out.union(own)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of documents whose own text holds `percent` of no item's shingles, whatever their ids are."""
    place = documents.columns.index("text")
    fields = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    out = documents
    for sketches in _blocks(benchmark, k, percent, block):
        shared = documents.sparkSession.sparkContext.broadcast(sketches)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[row for row, *_ in _found(shared.value, batch.column(place))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(tidy(run), fields)
    return out


#: For op2 with k = 5 and 80 percent.
ORACLE_SQL = r"""
WITH item_words AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_sets AS (SELECT r, item_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
doc_words AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
doc_sets AS (SELECT d, doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS x FROM doc_words, (SELECT DISTINCT k FROM item_sets) WHERE len(w) >= k),
item_rows AS (SELECT r, item_id, k, len(s) AS n_item, unnest(s) AS x FROM item_sets)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, count(*) / CAST(n_item AS DOUBLE) AS containment
FROM doc_sets JOIN item_rows USING (x, k) GROUP BY d, doc_id, r, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
