"""Centroid clustering by Yinyang grouping, in exact integers.

1. Vectors become integers, floor(scale x), and are packed to blocks of BLOCK rows: a table of blocks, each with its rows'
   state: cluster, an upper bound on the distance to its centroid, a lower bound for each group of centroids.
2. The centroids are cut into groups once, by a few rounds of k-means over the first centroids themselves.
3. A round is one pass over the blocks. Bounds move by how far centroids did. A row whose upper bound is below all of its
   lower bounds keeps its cluster (global filter); else its own distance is computed and it is tried again; then a group is
   passed over if its bound is beyond the row's (group filter), and of the others' centroids those are that their own
   movement can't have brought near enough (local filter). What is left is computed exactly, in integers.
4. A task reports by how much rows that changed their cluster change the sums; those numbers (k x (width + 1)) are added up
   by Spark and come to the driver, which makes the next centroids. Each round's blocks are written to the shared folder,
   and the round before is deleted; lost executors cost their own tasks only.

No key is shuffled but (centroid, component) of the sums. Bounds are widened by more than rounding can do, so pruning never
changes a result; rounds end early only where no centroid moved, which further rounds wouldn't change either.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; integers
beyond 2^27 count as 2^27 (and -2^27), so a squared distance fits a long, as sums of them do up to the greatest long, which
greater sums become; ties go to the smaller centroid; of equal seed hashes the lesser vector begins; rows with a null id are
assigned like others but begin no centroid unless no other is left; repeated rows count each; fewer rows than k begin fewer
centroids; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill.llm.runtime import discard, stored, tidy

BLOCK, TOP = 4096, 1 << 27
_OVER, _UNDER = 1 + 1e-12, 1 - 1e-12
_SCHEMA = "ids array<bigint>, data binary, state binary, moved binary"
_NAMES = ["ids", "data", "state", "moved"]
_TYPES = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integers."""
    own = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    inside = np.repeat(own == width, np.maximum(own, 0))
    x = flat[inside].reshape(-1, width)
    good = np.isfinite(x).all(axis=1)
    rows = np.flatnonzero(own == width)[good]
    with np.errstate(over="ignore"):
        return rows, np.clip(np.floor(x[good] * scale), -TOP, TOP).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i4").tobytes()


def _rows(held: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(held, f"<i{len(held) // (n * width)}").reshape(n, width).astype(np.int64)


def _record(*rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows to one centroid, or of each row to its own."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Model:
    """Centroids, their groups, and how far the last round moved them."""

    def __init__(self, centroids: np.ndarray, groups: int):
        self.c = centroids
        self.moved = np.zeros(len(centroids))
        self.group = self._grouped(groups)
        self.groups = [np.flatnonzero(self.group == g) for g in range(self.group.max(initial=-1) + 1)]

    def _grouped(self, groups: int) -> np.ndarray:
        """The group of each centroid, numbered without gaps."""
        x = self.c.astype(np.float64)
        heads = x[: max(1, groups)].copy()
        near = np.zeros(len(x), int)
        for _ in range(5):
            if len(x):
                near = np.square(x[:, None] - heads[None]).sum(axis=2).argmin(axis=1)
            for g in np.unique(near):
                heads[g] = x[near == g].mean(axis=0)
        return np.unique(near, return_inverse=True)[1]

    def to(self, centroids: np.ndarray) -> None:
        self.moved = np.sqrt(squared(centroids, self.c).astype(np.float64)) * _OVER
        self.c = centroids

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper bound and lower bounds of rows without a state."""
        all_of = np.stack([squared(x, c) for c in self.c], axis=1)
        own = all_of.argmin(axis=1)
        upper = np.sqrt(all_of[np.arange(len(x)), own].astype(np.float64)) * _OVER
        far = np.sqrt(all_of.astype(np.float64)) * _UNDER
        far[np.arange(len(x)), own] = np.inf
        return own, upper, np.stack([far[:, g].min(axis=1) for g in self.groups], axis=1)

    def step(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the last move of the centroids, and how many distances were computed."""
        before, upper = lower, (upper + self.moved[own]) * _OVER
        lower = (before - np.array([self.moved[g].max() for g in self.groups])) - 1e-9
        rows = np.flatnonzero(upper >= lower.min(axis=1))
        work = len(rows)
        exact = squared(x[rows], self.c[own[rows]])
        upper[rows] = np.sqrt(exact.astype(np.float64)) * _OVER
        near = upper[rows] >= lower[rows].min(axis=1)
        rows, exact = rows[near], exact[near]
        best, now = exact.copy(), own[rows].copy()
        scanned = []
        for g, members in enumerate(self.groups):
            at = np.flatnonzero(lower[rows, g] <= upper[rows])
            if not len(at):
                continue
            least, which, rest = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), -1), np.full(len(at), np.inf)
            for j in members.tolist():
                bound = before[rows[at], g] - self.moved[j] - 1e-9
                mine = own[rows[at]] == j
                pruned = ~mine & (bound > upper[rows[at]])
                rest[pruned] = np.minimum(rest[pruned], bound[pruned])
                s = np.flatnonzero(~pruned)
                d = np.where(mine[s], exact[at[s]], 0)
                other = np.flatnonzero(~mine[s])
                d[other] = squared(x[rows[at[s[other]]]], self.c[j])
                work += len(other)
                better = d < least[s]
                second = np.where(better, least[s], d)
                rest[s] = np.minimum(rest[s], np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)) * _UNDER))
                least[s], which[s] = np.where(better, d, least[s]), np.where(better, j, which[s])
            wins = (which >= 0) & ((least < best[at]) | ((least == best[at]) & (which < now[at])))
            best[at[wins]], now[at[wins]] = least[wins], which[wins]
            scanned.append((g, at, least, which, rest))
        # A centroid that was left counts in its group's bound; if the group was scanned, the scan has it.
        left = np.flatnonzero(now != own[rows])
        home = self.group[own[rows[left]]]
        lower[rows[left], home] = np.minimum(lower[rows[left], home], np.sqrt(exact[left].astype(np.float64)) * _UNDER)
        for g, at, least, which, rest in scanned:
            seen = np.where(which >= 0, np.sqrt(least.astype(np.float64)) * _UNDER, np.inf)
            lower[rows[at], g] = np.where(which == now[at], rest, np.minimum(rest, seen))
        own = own.copy()
        own[rows], upper[rows] = now, np.sqrt(best.astype(np.float64)) * _OVER
        return own, upper, lower, work

    def pack(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> bytes:
        return own.astype("<i4").tobytes() + upper.astype("<f8").tobytes() + lower.astype("<f8").tobytes()

    def unpack(self, held: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, bounds = np.frombuffer(held, "<i4", n).astype(np.int64), np.frombuffer(held, "<f8", offset=4 * n)
        return own, bounds[:n], bounds[n:].reshape(n, len(self.groups))


def _blocks(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for batch in batches:
            rows, x = integers(batch.column(1), width, scale)
            ids.append(batch.column(0).take(pa.array(rows))), held.append(x)
            n += len(rows)
            while n >= BLOCK:
                own, x = pa.concat_arrays(ids), np.concatenate(held)
                yield _record((own[:BLOCK].to_pylist(), _packed(x[:BLOCK]), None, None))
                ids, held, n = [own[BLOCK:]], [x[BLOCK:]], n - BLOCK
        if n:
            yield _record((pa.concat_arrays(ids).to_pylist(), _packed(np.concatenate(held)), None, None))

    return vectors.mapInArrow(tidy(run), _SCHEMA)


def _seeds(blocks: DataFrame, k: int, width: int, seed: int) -> np.ndarray:
    """The k rows of least sha256("<seed>:<id>")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _rows(data, len(ids), width)
                h = ["~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
                last = sorted(h)[min(k, len(h)) - 1]  # all rows of the last hash stay, as their vectors decide
                found = sorted([*found, *((a, tuple(x[i].tolist())) for i, a in enumerate(h) if a <= last)])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([list(v) for _, v in found], pa.list_(pa.int64()))], ["h", "v"])

    rows = blocks.select("ids", "data").mapInArrow(tidy(run), "h string, v array<bigint>").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), width)


def _assigned(blocks: DataFrame, model: Model, width: int) -> DataFrame:
    """The blocks with their new states, and of each task a row with what it moves in the sums."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((len(m.c), width + 1), np.int64)
        for batch in batches:
            for ids, data, state in zip(*(batch.column(i) for i in range(3))):
                n, data, state = len(ids), data.as_py(), state.as_py()
                x = _rows(data, n, width)
                if state is None:
                    own, upper, lower = m.first(x)
                    here = np.arange(n)
                else:
                    old, upper, lower = m.unpack(state, n)
                    own, upper, lower, _ = m.step(x, old, upper, lower)
                    here = np.flatnonzero(own != old)
                    np.subtract.at(total[:, :width], old[here], x[here])
                    np.subtract.at(total[:, width], old[here], 1)
                np.add.at(total[:, :width], own[here], x[here])
                np.add.at(total[:, width], own[here], 1)
                yield _record((ids.as_py(), data, m.pack(own, upper, lower), None))
        yield _record((None, None, None, total.astype("<i8").tobytes()))

    return blocks.where("ids IS NOT NULL").select(*_NAMES).mapInArrow(tidy(run), _SCHEMA)


def _sums(blocks: DataFrame, size: int) -> np.ndarray:
    """The tasks' changes of the sums, added up: one row a number, for k x (width + 1) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                total += np.frombuffer(held, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["i", "x"])

    out = np.zeros(size, np.int64)
    for i, x in blocks.where("moved IS NOT NULL").select("moved").mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def _distances(blocks: DataFrame, model: Model, width: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for ids, data, state in zip(*(batch.column(i) for i in range(3))):
                n = len(ids)
                x = _rows(data.as_py(), n, width)
                own = m.first(x)[0] if state.as_py() is None else m.step(x, *m.unpack(state.as_py(), n))[0]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(own, pa.int32()), pa.array(squared(x, m.c[own]), pa.int64())], ["vec_id", "cluster", "distance"])

    return blocks.where("ids IS NOT NULL").select(*_NAMES).mapInArrow(tidy(run), "vec_id long, cluster int, distance long")


def fit(vectors: DataFrame, k: int, rounds: int, width: int, scale: int, seed: int, groups: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the rows of (vec_id, embedding) that take part, and the final centroids, k rows at most.

    k x width numbers are held by the driver and sent to every task, whatever the input's size. groups: k / 10 by default.
    """
    spark: SparkSession = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    paths: list[str] = []
    blocks = stored(_blocks(rows, width, scale), paths)
    model = Model(_seeds(blocks, k, width, seed), groups or max(1, k // 10))
    k = len(model.c)
    if not k:
        return rows.where("false").selectExpr("vec_id", "CAST(NULL AS int) AS cluster", "CAST(NULL AS long) AS distance"), model.c
    sums = np.zeros((k, width + 1), np.int64)
    for _ in range(rounds):
        blocks = stored(_assigned(blocks, model, width), paths)
        discard(spark, [paths.pop(0)])
        sums += _sums(blocks, k * (width + 1)).reshape(sums.shape)
        count = sums[:, width:]
        centroids = np.where(count > 0, sums[:, :width] // np.maximum(count, 1), model.c)
        model.to(centroids)
        if not model.moved.any():
            break
    out = stored(_distances(blocks, model, width))
    discard(spark, paths)
    return out, model.c


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, groups: int | None = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row that takes part."""
    rows, centroids = fit(vectors, k, rounds, width, scale, seed, groups)
    by = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    total = min(most, sum(by.values()))
    facts = [(i, min(most, s), total, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in by.items()]
    table = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL of `cluster`: one group of tables for each round."""
    assign = "SELECT rid, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.rid, m.c, CAST(sum((x.v - m.v) * (x.v - m.v)) AS BIGINT) AS d FROM x JOIN m{r} m ON x.i = m.i GROUP BY x.rid, m.c) GROUP BY rid"
    parts = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT rid, i, CAST(floor({scale} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v FROM k, range(1, {width + 1}) t(i))",
        f"s AS MATERIALIZED (SELECT rid, CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS c FROM k QUALIFY c < {k})",
        "m0 AS MATERIALIZED (SELECT c, i, v FROM s JOIN x USING (rid))",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({assign.format(r=r)})")
        new = f"SELECT a.c, x.i, sum(x.v) AS s, count(*) AS n FROM a{r} a JOIN x USING (rid) GROUP BY a.c, x.i"
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v FROM m{r} m LEFT JOIN ({new}) USING (c, i))")
    parts.append(f"z AS MATERIALIZED ({assign.format(r=rounds)})")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, z.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM z JOIN k USING (rid) JOIN h ON h.c = z.c"
