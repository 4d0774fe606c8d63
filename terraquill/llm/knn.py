"""Exact top-k by inner product: a Voronoi join of queries with all data.

1. Components become integers, floor(64 x). Equal vectors count once: of each only the k + 1 least ids can be among any
   query's k best, so no more of them are dealt out, however many there are.
2. Pivots, a hashed sample of the vectors, cut the space into cells; queries and data go to their nearest pivot's. Data
   keep r = |x - pivot|.
   Vectors keep their own length; inside a task those of like length are multiplied together, so a few very long ones make
   nothing else longer. Vectors above LONGEST bytes are no pivots and not in the sample.
3. A sample of the data gives each query q a floor t: its k-th best score there, which the true one can't be below; where
   queries are solved, it also holds back all lower scores from the first batch on. As
   q x = q p + q (x - p) <= q p + |q| r, and q x <= |q| |x|, a vector of cell j can matter to a query of cell i only if
   r >= min over the cell's q of (t - q p_j) / |q| and |x| >= min of t / |q|. These summaries (cells x cells numbers) come
   to the driver and are broadcast; their size doesn't depend on the input.
4. Query cells that need much the same data become one group, as long as its queries are few enough for a task: two groups
   are joined where the sample's vectors that either needs are at most JOINED of those that both are sent apart.
5. A vector is sent once to each group of which a cell needs it. A cell of very many queries is cut into blocks of QUERIES,
   and the data sent to a block into shards by a hash of their id, so no task holds more than a block of queries and a
   batch of data; shards are solved by matrix products and merged by rank.

How often a vector is sent depends on the data: where the bounds hold nothing back (directions spread evenly over many
dimensions), all vectors go to all groups, of which there are queries / QUERIES.

Results are exact: bounds are widened by more than rounding can do, and products are exact integers (64-bit floats while
they stay below 2^53, else 64-bit or longer integers). Shorter vectors count as having zeros at their end. Defined results:
vectors that are null, empty or hold null or non-finite components take no part, nor do those with a component of 2^57 or
more, whose integer has more than 64 bits; scores beyond 64 bits become the greatest or least long; ties go to the smaller
id; null ids take no part. Rows equal in id and integers count once, as queries and as candidates. An id with several
vectors has a query and a candidate for each, and none of them is a candidate of that id's queries. Fewer candidates than
k give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquill.llm.runtime import counted, cut, tidy

QUERIES, SHARD_ROWS, LEAST_ROWS, SAMPLE, SCALE, JOINED = 4096, 500_000, 4096, 2048, 64, 0.8
_BATCH = 2048
#: Bytes of a vector of the sample, which is held whole; numbers of a matrix; bytes of data that wait to be multiplied.
LONGEST, NUMBERS, WAITING = 1 << 15, 1 << 22, 1 << 25


def _integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): integer components, little-endian, 2, 4 or 8 bytes each as the largest needs (the first byte tells), without
    zeros at the end, but for one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.floor(np.array(v, np.float64) * SCALE)
                top = np.abs(x).max()
                if not top < 1 << 63:
                    continue
                kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
                last = np.flatnonzero(x)
                n = x[: last[-1] + 1 if len(last) else 1].astype(kind)
                ids.append(i), held.append(bytes([n.itemsize]) + n.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], ["vec_id", "v"])

    return vectors.mapInArrow(tidy(run), "vec_id long, v binary")


def matrix(held: list[bytes]) -> np.ndarray:
    """int64 rows, as long as the longest."""
    width = max(((len(v) - 1) // v[0] for v in held), default=0)
    if len(kinds := {v[0] for v in held}) == 1:
        size = kinds.pop()
        return np.frombuffer(b"".join(v[1:].ljust(width * size, b"\0") for v in held), f"<i{size}").reshape(len(held), width).astype(np.int64)
    out = np.zeros((len(held), width), np.int64)
    for row, v in zip(out, held):
        row[: (len(v) - 1) // v[0]] = np.frombuffer(v, f"<i{v[0]}", offset=1)
    return out


def grouped(held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows): matrices of at most _BATCH vectors of like length, none more than twice as long as another."""
    size = np.array([(len(v) - 1) // v[0] for v in held], np.int64)
    order = np.argsort(size, kind="stable")
    size, at = size[order], 0
    while at < len(order):
        end = min(at + _BATCH, int(np.searchsorted(size, 2 * size[at], "right")))
        end = min(end, at + max(1, NUMBERS // int(size[end - 1])))
        yield order[at:end], matrix([held[i] for i in order[at:end]])
        at = end


class Rows:
    """Vectors of any lengths, as (places, rows) of like length."""

    def __init__(self, groups: list[tuple[np.ndarray, np.ndarray]]):
        self.groups, self.n = groups, sum(len(places) for places, _ in groups)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Exact inner products of all vectors with the rows of x, (vectors, rows)."""
        out = np.empty((self.n, len(x)), np.int64)
        for places, rows in self.groups:
            out[places] = products(rows, x)
        return out


def _inner(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of float rows; shorter rows have zeros at their end."""
    w = min(x.shape[1], p.shape[1])
    return x[:, :w] @ p[:, :w].T


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of int64 rows; shorter rows have zeros at their end."""
    width = min(q.shape[1], x.shape[1])
    q, x = q[:, :width], x[:, :width]
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    whole = np.array(q.tolist(), object) @ np.array(x.tolist(), object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Cells:
    """Pivots, and the bounds of query cells."""

    def __init__(self, pivots: np.ndarray):
        self.p = pivots.astype(np.float64)
        self.square = np.square(self.p).sum(axis=1)
        self.reach = self.long = self.blocks = self.group = None

    def wanted(self, x: np.ndarray) -> np.ndarray:
        """By rows: which query cells a vector may matter to."""
        cell, r = self.nearest(x)
        size = np.sqrt(np.square(x.astype(np.float64)).sum(axis=1))
        slack = 1e-9 * (1 + size + r)
        return ((r + slack)[:, None] >= self.reach[:, cell].T) & ((size + slack)[:, None] >= self.long[None, :])

    def merge(self, sample: Rows, counts: np.ndarray) -> None:
        """Groups of cells with queries, and how many blocks of queries each has."""
        want = np.concatenate([np.zeros((0, len(self.p)), bool), *(self.wanted(rows) for _, rows in sample.groups)])
        groups = [[[int(i)], want[:, i], int(counts[i])] for i in np.flatnonzero(counts)]
        while len(groups) > 1:
            best = None
            for i, (_, a, n) in enumerate(groups):
                for j in range(i):
                    _, b, m = groups[j]
                    apart = int(a.sum()) + int(b.sum())
                    if n + m <= QUERIES and (share := int((a | b).sum()) / max(1, apart)) <= JOINED and (best is None or share < best[0]):
                        best = share, i, j
            if best is None:
                break
            i, j = best[1:]
            a = groups.pop(i)
            b = groups[j]
            groups[j] = [b[0] + a[0], b[1] | a[1], b[2] + a[2]]
        self.group, self.blocks = np.full(len(self.p), -1), np.array([max(1, -(-n // QUERIES)) for *_, n in groups], np.int64)
        for g, (cells, *_) in enumerate(groups):
            self.group[cells] = g

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        cell, w = (self.square - 2 * _inner(x, self.p)).argmin(axis=1), min(x.shape[1], self.p.shape[1])
        own = self.p[cell]
        return cell, np.sqrt(np.square(x[:, :w] - own[:, :w]).sum(axis=1) + np.square(x[:, w:]).sum(axis=1) + np.square(own[:, w:]).sum(axis=1))


_NONE = np.iinfo(np.int64).min


def _floors(q: np.ndarray, ids: np.ndarray, sample: Rows, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th best score in the sample, which its k-th best of all is not below."""
    if len(sample_ids) < k:
        return np.full(len(q), _NONE)
    s = sample.scores(q).T
    s[ids[:, None] == sample_ids[None, :]] = _NONE
    return np.partition(s, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k]


def _summaries(queries: DataFrame, cells: Cells, sample: tuple, k: int) -> list:
    shared = queries.sparkSession.sparkContext.broadcast((cells, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, (ids_s, x_s) = shared.value
        n = len(cells.p)
        reach, long, count = np.full((n, n), np.inf), np.full(n, np.inf), np.zeros(n, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for places, q in grouped(batch.column(1).to_pylist()):
                cell, _ = cells.nearest(q)
                t = _floors(q, ids[places], x_s, ids_s, k)
                t = np.where(t == _NONE, -np.inf, t.astype(np.float64))
                size = np.sqrt(np.square(q.astype(np.float64)).sum(axis=1))
                zero = size == 0
                size[zero] = 1
                near = (t[:, None] - _inner(q.astype(np.float64), cells.p)) / size[:, None]
                far = t / size
                near[zero], far[zero] = -np.inf, -np.inf
                np.minimum.at(reach, cell, near)
                np.minimum.at(long, cell, far)
                count += np.bincount(cell, minlength=n)
        i, j = np.nonzero(np.broadcast_to(count[:, None] > 0, (n, n)))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(reach[i, j]), pa.array(long[i]), pa.array(count[i])], ["i", "j", "reach", "long", "count"])

    made = queries.mapInArrow(tidy(run), "i long, j long, reach double, long double, count long")
    return made.groupBy("i", "j").agg(F.min("reach"), F.min("long"), F.sum("count")).collect()


def _dealt(df: DataFrame, cells: Cells, kind: int, shards: int) -> DataFrame:
    """(i, b, s, kind, vec_id, v): queries to their group's block in every shard, data to the groups that may need them."""
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            every = batch.column(0).to_numpy()
            for places, x in grouped(batch.column(1).to_pylist()):
                ids = every[places]
                if kind == 0:
                    row = np.repeat(np.arange(len(ids)), shards)
                    i, s = cells.group[cells.nearest(x)[0]][row], np.tile(np.arange(shards), len(ids))
                    b = (ids[row] // 20) % cells.blocks[i]
                else:
                    want = cells.wanted(x)
                    row, i = np.nonzero(np.stack([want[:, cells.group == g].any(axis=1) for g in range(len(cells.blocks))], axis=1))
                    times = cells.blocks[i]
                    b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, i = np.repeat(row, times), np.repeat(i, times)
                    s = ids[row] % shards
                if len(row):
                    v = batch.column(1).take(pa.array(places[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (i, b, s, np.full(len(row), kind), ids[row])] + [v], ["i", "b", "s", "kind", "vec_id", "v"])

    return df.mapInArrow(tidy(run), "i long, b long, s long, kind long, vec_id long, v binary")


def _names(held: list[bytes]) -> np.ndarray:
    """Tells vectors of one id apart."""
    return np.array([int.from_bytes(blake2b(v, digest_size=8).digest(), "little", signed=True) for v in held], np.int64)


class _Best:
    """The k best (score, id) of a block of queries. least: of each, a score that its k-th best is not below."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, q: Rows, k: int, least: np.ndarray):
        self.ids, self.names, self.q, self.k, self.least = ids, names, q, k, least
        self.row = self.score = self.who = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        s = self.q.scores(x)
        row, new = np.nonzero((s >= self.least[:, None]) & (self.ids[:, None] != ids[None, :]))
        row, score, who = np.concatenate([self.row, row]), np.concatenate([self.score, s[row, new]]), np.concatenate([self.who, ids[new]])
        order = np.lexsort((who, ~score, row))
        row, score, who = row[order], score[order], who[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last, kept = place == self.k - 1, place < self.k
        self.least[row[last]] = score[last]
        self.row, self.score, self.who = row[kept], score[kept], who[kept]


def _solve(dealt: DataFrame, sample: tuple, k: int) -> DataFrame:
    shared = dealt.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, ids, held, queries, waiting = None, None, [], [], True, 0

        def flush() -> None:
            nonlocal best, ids, held, waiting
            if held:
                n, (ids_s, x_s) = np.array(ids, np.int64), shared.value
                if queries:
                    q, least = Rows(list(grouped(held))), np.empty(len(n), np.int64)
                    for places, x in q.groups:
                        least[places] = _floors(x, n[places], x_s, ids_s, k)
                    best = _Best(n, _names(held), q, k, least)
                elif best is not None:
                    for places, x in grouped(held):
                        best.add(n[places], x)
            ids, held, waiting = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            flush()
            if best is not None and len(best.row):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (best.ids[best.row], best.names[best.row], best.who, best.score)], ["query_id", "query", "vec_id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for *k3, kind, i, v in zip(*columns):
                if k3 != key:
                    yield from done()
                    key, best, queries = k3, None, True
                if queries and kind == 1:
                    flush()
                    queries = False
                ids.append(i), held.append(v)
                waiting += len(v)
                if not queries and (len(held) >= _BATCH or waiting >= WAITING):
                    flush()
        yield from done()

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(parts, "i", "b", "s").sortWithinPartitions("i", "b", "s", "kind")
    return placed.mapInArrow(tidy(run), "query_id long, query long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by `every`."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = cut(_integers(rows).distinct())
    first, each = W.partitionBy("v", "_part").orderBy("vec_id"), W.partitionBy("v").orderBy("vec_id")
    salted = vectors.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    data, state = counted(salted.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= k + 1).select("vec_id", "v"))
    queries = vectors.where(F.col("vec_id") % every == 0)
    n = state.rows
    cells = cells or max(1, min(128, int(math.sqrt(n) / 12)))
    picked = data.where(F.length("v") <= LONGEST).withColumn("_h", F.xxhash64("v", "vec_id")).orderBy("_h", "vec_id").limit(SAMPLE).collect()
    held = [bytes(r["v"]) for r in picked]
    x, distinct = Rows(list(grouped(held))), sorted(set(held))
    known = Cells(matrix(distinct[:: max(1, len(held) // cells)][:cells]) if held else np.zeros((1, 1), np.int64))
    shape = len(known.p)
    known.reach, known.long, counts = np.full((shape, shape), np.inf), np.full(shape, np.inf), np.zeros(shape, np.int64)
    sample = np.array([r["vec_id"] for r in picked], np.int64), x
    for i, j, reach, long, count in _summaries(queries, known, sample, k):
        known.reach[i, j], known.long[i], counts[i] = reach, long, count
    known.reach -= 1e-7 * (1 + np.abs(np.nan_to_num(known.reach, posinf=0, neginf=0)))
    known.long -= 1e-7 * (1 + np.abs(np.nan_to_num(known.long, posinf=0, neginf=0)))
    known.merge(x, counts)
    spread = min(2 * embeddings.sparkSession.sparkContext.defaultParallelism / max(1, int(known.blocks.sum())), n / LEAST_ROWS)
    shards = max(1, math.ceil(spread), -(-n // SHARD_ROWS))
    found = _solve(_dealt(queries, known, 0, shards).union(_dealt(data, known, 1, shards)), sample, k)
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: For op6; floor(64 x) as double, products of integers.
ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
