"""Exact Jaccard self-join of word-shingle sets: size-banded tiles with hashed signatures, bit counts, exact overlap.

1. A text becomes the set of its distinct k-word shingles, as ascending 64-bit hashes.
2. Sets are banded by size. Two sets that link at the threshold differ by at most H shingles, H known from the band of
   the smaller. The hash space is cut into m = H + 1 + SPARE equal slices, so linked sets agree wholly on at least
   SPARE + 1 of them: (band, slice, sum of the mixed shingles in it) is a tile, and linked sets share one. A set also
   stands in the tiles of the band below if a partner can be there. A set with more than SPARE empty slices has tiles for
   those too. Where m exceeds SLICES, the first SLICES slices do: H differences leave each untouched with probability
   above 1 / e, and the chance that none of SLICES is (they are negatively associated) is below 2^-64, that of an equal
   64-bit hash. Small bands use the first |s| - ceil(t |s|) + 1 shingles in hash order (linked sets share one of these).
3. Tiles with one set vanish, and of tiles with the same sets one stays. A tile of more sets than a block holds is cut
   into blocks by a hash, and first only its first block is held against the others (linear in its rows). Of what is then
   still in several components, blocks are held against blocks, but never two blocks of the tile's greatest component.
4. A pair is held against each other by hashed parity bitmaps, at most 1/8 of the set's bytes: bits that differ are at most
   the shingles that differ, so their count bounds the overlap from above. Tiles carry the bitmaps only. Distinct pairs
   that pass get the exact intersection of the sorted arrays, streamed past the pair's lesser set. A tile joins its passing
   pairs at once; if the exact test then refuses one of them, what is still in several components in that tile is tested
   again where the sets themselves lie together (those that bitmaps let pass with any other): tiles that share such sets
   become one block where they fit, so a set moves once, and only links that join components come out, however many pairs there are just below the threshold. There exact
   overlaps come from lists of who has (or, where most do, lacks) a shingle, so near-equal sets cost what differs.
5. Links become components by star contraction. Only links that join components are kept; none is lost between them.

Equal sets are one node throughout. Hot tiles: a task emits equal sets once, and of a tile that it meets more than HOT times
all but two sets travel packed, dealt out evenly, so no task gathers a tile to find that it is shared; blocks are bounded in
bytes and sets, stars are salted by the number of their members. No cap drops a pair. Nothing is collected to the driver.

Defined results: null, empty or wordless text has an empty set and links with nothing; repeated rows link with each
other (all have the same id, if the id repeats); a null id has a null component; an empty table gives an empty result.
Sets are compared by 64-bit shingle hashes and identified by 128 bits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquill.llm import textkit
from terraquill.llm.components import Forest, components
from terraquill.llm.runtime import counted, cut, discard, lookup_join, shared_dir, stored, tidy

_U = np.uint64
SPARE = 2
SMALL = 16
SLICES = 97
#: Bytes of sets or bitmaps that one block of a tile holds, and its most and least sets.
BLOCK_BYTES, BLOCK_MOST, BLOCK_LEAST = 32 << 20, 8192, 64
#: Most bytes of a bitmap for a shingle; of a set, with the lists of who has an element, where sets lie together.
BITS, ARRAYS = 1.0, 18.0
#: 64-bit words of bitmaps that are compared at a time.
HELD = 1 << 18
#: Members of one star that a task handles.
STAR = 512
#: Digests that a task remembers to emit equal sets once; tile rows that it looks through at a time.
SEEN, LOOKED = 500_000, 1 << 20
#: Sets of one tile among those, beyond which they travel packed, and the most in a pack.
HOT, PACK = 64, 4096


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest overlap at which sets of a and b elements have 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class Bands:
    """Bands of set sizes for a threshold in percent, and the tiles of a set."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("the threshold is 1 to 100 percent")
        self.percent, self.edges, self.plans, self.salts = percent, [1], {}, {}

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * 1.5)))
        return bisect_right(self.edges, size) - 1

    def plan(self, band: int) -> np.ndarray | None:
        """The inner bounds of a band's slices; None for a small band."""
        if band not in self.plans:
            top = self.edges[band + 1] - 1
            if top <= SMALL:
                self.plans[band] = None
            else:
                differ = (top + 100 * top // self.percent) * (100 - self.percent) // (100 + self.percent)
                m = differ + 1 + SPARE
                self.plans[band] = np.array([(i << 64) // m for i in range(1, min(m, SLICES + 1))], _U)
                self.salts[band] = textkit.mix(np.arange(1, min(m, SLICES) + 1, dtype=_U) * _U(0xD6E8FEB86659FD93) + _U(band + 1))
        return self.plans[band]

    def tiles(self, u: np.ndarray, offsets: np.ndarray, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The tiles of some rows of `textkit.sets`, and how many each row has."""
        sums = np.zeros(len(u) + 1, _U)
        np.cumsum(textkit.mix(u), out=sums[1:])
        slices, salts, counts = [], [], []
        for row in rows:
            lo, hi = int(offsets[row]), int(offsets[row + 1])
            n, own, prefix = hi - lo, 0, False
            for band in range(self.band(-(-self.percent * n // 100)), self.band(n) + 1):
                bounds = self.plan(band)
                if bounds is None:
                    prefix = True
                    continue
                count = len(self.salts[band])
                at = np.empty(count + 1, np.int64)
                at[0], at[-1] = 0, n  # the last slice ends at the end, unless only the first of many are taken
                at[1 : len(bounds) + 1] = np.searchsorted(u[lo:hi], bounds)
                full = at[1:] > at[:-1]
                at += lo
                x = sums[at]
                x, salt = x[1:] - x[:-1], self.salts[band]
                if len(x) - np.count_nonzero(full) <= SPARE:
                    x, salt = x[full], salt[full]
                slices.append(x)
                salts.append(salt)
                own += len(x)
            first = u[lo : lo + n - -(-self.percent * n // 100) + 1] if prefix else u[:0]
            slices.append(first)
            salts.append(np.zeros(len(first), _U))
            counts.append(own + len(first))
        if not rows:
            return u[:0], np.zeros(0, np.int64)
        return textkit.mix(textkit.mix(np.concatenate(slices) ^ _U(0x5851F42D4C957F2D)) + np.concatenate(salts)), np.array(counts)


def _mixed(u: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's identity, for rows of `textkit.sets`; of an empty set anything."""
    n = np.diff(offsets)
    out = []
    for v in (u + _U(0x2545F4914F6CDD1D), u ^ _U(0x369DEA0F31A53F85)):
        sums = np.zeros(len(u) + 1, _U)
        np.cumsum(textkit.mix(v), out=sums[1:])
        out.append(textkit.mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(_U)).view(np.int64))
    return out[0], out[1]


def _sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return textkit.sets(batch.column(batch.schema.get_field_index("text")), k)


def identities(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, a, b, s): each row's set by size, 128-bit identity and bitmap; a, b and s null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, u, offsets in _sets_of(batch, k):
                n, (a, b) = np.diff(offsets), _mixed(u, offsets)
                bits = [bitmap(u[offsets[r] : offsets[r + 1]], width_of(int(n[r]))).tobytes() if n[r] else None for r in range(len(n))]
                own = [batch.column(0).slice(lo, len(n)), pa.array(n, pa.int64()), pa.array(a, mask=n == 0), pa.array(b, mask=n == 0), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, ["doc_id", "n_shingles", "a", "b", "s"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, a long, b long, s binary")


def packed(tile: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Rows (tile, a) as plain rows and packs [tile, a, a, ...]: of a tile with more than HOT rows two rows stay plain."""
    order = np.argsort(tile, kind="stable")
    tile, a = tile[order], a[order]
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(tile)))
    plain, packs = np.ones(len(tile), bool), []
    for lo, n in zip(first[count > HOT].tolist(), count[count > HOT].tolist()):
        plain[lo + 2 : lo + n] = False
        packs += [[int(tile[lo]), *a[at : min(at + PACK, lo + n)].tolist()] for at in range(lo + 2, lo + n, PACK)]
    return tile[plain], a[plain], packs


def _tiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(tile, a, pack): in which tiles the set of identity a stands; a task emits equal sets once. pack: see `packed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def looked() -> Iterator[pa.RecordBatch]:
            tile, a, packs = packed(*(np.concatenate(x) for x in zip(*held)))
            # A pack's own key spreads it and meets no tile.
            keys = textkit.mix(np.array([p[0] ^ p[1] for p in packs], np.int64).view(_U)).view(np.int64)
            held.clear()
            for at in range(0, len(tile), 1 << 16):
                x = tile[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(a[at : at + (1 << 16)]), pa.nulls(len(x), pa.list_(pa.int64()))], ["tile", "a", "pack"])
            for at in range(0, len(packs), 256):
                x = keys[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(x), pa.array(packs[at : at + 256], pa.list_(pa.int64()))], ["tile", "a", "pack"])

        for batch in batches:
            for _, u, offsets in _sets_of(batch, k):
                a, b = _mixed(u, offsets)
                rows = []
                for row, who in enumerate(zip(a.tolist(), b.tolist())):
                    if offsets[row] < offsets[row + 1] and who not in seen:
                        seen.add(who)
                        rows.append(row)
                if len(seen) > SEEN:
                    seen.clear()
                tiles, counts = bands.tiles(u, offsets, rows)
                held.append((tiles.view(np.int64), np.repeat(a[rows], counts)))
                if sum(len(x) for x, _ in held) >= LOOKED:
                    yield from looked()
        if held:
            yield from looked()

    return docs.mapInArrow(tidy(run), "tile long, a long, pack array<bigint>")


def shared_tiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(tile, a) without repetitions, of tiles with more than one set."""
    w = W.partitionBy("tile")
    all_rows = _tiles(docs, k, percent).select("tile", "a", "pack", F.min("a").over(w).alias("least"), F.max("a").over(w).alias("most"))
    kept = all_rows.where("pack IS NOT NULL OR least < most")
    here = F.when(F.col("pack").isNull(), F.array("a")).otherwise(F.slice("pack", F.lit(2), F.size("pack")))
    kept = kept.select(F.when(F.col("pack").isNull(), F.col("tile")).otherwise(F.get("pack", F.lit(0))).alias("tile"), F.explode(here).alias("a"))
    return kept.distinct()


def _arrays(docs: DataFrame, nodes: DataFrame, k: int, rows: int) -> DataFrame:
    """(node, n, s): the sizes and sets of the given nodes (node, a), computed anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(batch.schema.get_field_index("a")).to_numpy()
            node = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, u, offsets in _sets_of(batch, k):
                n, (a, _) = np.diff(offsets), _mixed(u, offsets)
                keep = (n > 0) & (a == want[lo : lo + len(n)])
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets * 8), pa.py_buffer(u)]).filter(pa.array(keep)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([node.slice(lo, len(n)).filter(pa.array(keep)), pa.array(n[keep], pa.int64()), own], ["node", "n", "s"])

    own = lookup_join(docs, nodes.select(F.col("node").alias("doc_id"), "a"), "doc_id", rows=rows)
    return own.select("doc_id", "text", "a").mapInArrow(tidy(run), "node long, n long, s binary")


def width_of(n: int) -> int:
    """Bits of a set's bitmap: a power of two, at least 128 and four to eight for each element."""
    return 1 << max(7, (4 * n - 1).bit_length())


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """width / 64 words; a bit is the parity of the elements that hash to it."""
    words = np.zeros(width // 64, _U)
    np.bitwise_xor.at(words, ((s & _U(width - 1)) >> _U(6)).astype(np.int64), _U(1) << (s & _U(63)))
    return words


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same set has at fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two ascending arrays without repeats."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


class Overlaps:
    """Exact intersection sizes of one set of a block with all others, from lists of who has an element.

    Of an element that most sets have, the list is of those that lack it; elements of one set or of all cost nothing. So the
    work of sets that agree in a large part follows what differs.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.dense = 2 * count > self.n
        self.code, self.at = code.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(self.code, kind="stable")
        owner, ends = owner[order], np.cumsum(count)
        lists = np.where(self.dense, self.n - count, np.where(count > 1, count, 0))
        self.first = np.concatenate([[0], np.cumsum(lists)])
        self.who = np.empty(self.first[-1], np.int32)
        for e in np.flatnonzero(lists):
            own = owner[ends[e] - count[e] : ends[e]]
            if self.dense[e]:
                lacks = np.ones(self.n, bool)
                lacks[own] = False
                own = np.flatnonzero(lacks)
            self.who[self.first[e] : self.first[e + 1]] = own

    def _listed(self, elements: np.ndarray) -> np.ndarray:
        """How often each set is in the lists of some elements."""
        begin, size = self.first[elements], self.first[elements + 1] - self.first[elements]
        begin, size = begin[size > 0], size[size > 0]
        if not len(begin):
            return np.zeros(self.n, np.int64)
        at = np.arange(size.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.bincount(self.who[at], minlength=self.n)

    def of(self, i: int) -> np.ndarray:
        own = self.code[self.at[i] : self.at[i + 1]]
        dense = self.dense[own]
        return np.count_nonzero(dense) - self._listed(own[dense]) + self._listed(own[~dense])


def _passing(rows: list[tuple[int, int, int, int, np.ndarray]], percent: int, exact: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, bounds): by rows (side, node, component, size, array or bitmap) those of other components that may link,
    with what bounds their overlap from above.

    Side 0 is held against side 1, or, where there is a side 2 only, all against all.
    """
    n = np.array([r[3] for r in rows])
    words = min(width_of(int(x)) for x in n) // 64
    bits = np.stack([bitmap(r[4], words * 64) if exact else folded(r[4], words) for r in rows])
    component = np.array([r[2] for r in rows])
    side = np.array([r[0] for r in rows])
    ones, step = np.flatnonzero(side == 1), max(1, HELD // words)
    overlaps = Overlaps([r[4] for r in rows]) if exact and np.count_nonzero(side != 1) > 8 else None
    for i, row in enumerate(rows):
        if row[0] == 1:
            continue
        others = ones if row[0] == 0 else np.arange(i + 1, len(rows))
        a, b = n[i], n[others]
        others = others[(component[others] != row[2]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))]
        if not len(others):
            continue
        differ = np.concatenate([np.bitwise_count(bits[others[at : at + step]] ^ bits[i]).sum(axis=1, dtype=np.int64) for at in range(0, len(others), step)])
        least = -(-percent * (n[others] + a) // (100 + percent))
        bound = (n[others] + a - differ) // 2
        near = np.flatnonzero(bound >= least)
        if exact and len(near):
            bound[near] = overlaps.of(i)[others[near]] if overlaps else [_overlap(row[4], rows[j][4]) for j in others[near]]
            near = near[bound[near] >= least[near]]
        if len(near):
            yield i, others[near], bound[near]


def tile_links(rows: list[tuple[int, int, int, int, np.ndarray]], percent: int, exact: bool) -> Iterator[tuple[int, int]]:
    """Pairs within one tile that link (exact) or may. Those whose components an earlier pair of the tile joins are skipped,
    so fewer pairs come out than the tile has rows."""
    forest = Forest()
    for i, others, bound in _passing(rows, percent, exact):
        for j in others[np.argsort(-bound, kind="stable")].tolist():
            if forest.join(rows[i][2], rows[j][2]):
                yield rows[i][1], rows[j][1]


def tile_touched(rows: list[tuple[int, int, int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Each node of a tile that may link with one of another component, twice."""
    hit = np.zeros(len(rows), bool)
    for i, others, _ in _passing(rows, percent, False):
        hit[i] = True
        hit[others] = True
    for i in np.flatnonzero(hit).tolist():
        yield rows[i][1], rows[i][1]


def _solve(placed: DataFrame, percent: int, exact: bool, touched: bool = False) -> DataFrame:
    """Pairs (tile, u, v) found in tiles, or the nodes touched, twice; placed: (t0, t1, t2, side, node, component, n, s)."""
    t = ["t0", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held_bytes = None, [], 0

        def solved() -> Iterator[pa.RecordBatch]:
            if found := [] if len(rows) < 2 else list(tile_touched(rows, percent) if touched else tile_links(rows, percent, exact)):
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(u), pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["tile", "u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            held = batch.column(7)
            for i, (*k, side, node, component, n) in enumerate(zip(*columns)):
                if k != key:
                    yield from solved()
                    key, rows, held_bytes = k, [], 0
                if held_bytes > BLOCK_BYTES and side == 1 and k[2] < 0:  # a star needs its hub only to go on
                    yield from solved()
                    rows, held_bytes = [r for r in rows if r[0] == 0], 0
                rows.append((side, node, component, n, np.frombuffer(held[i].as_buffer(), _U).copy()))
                held_bytes += 8 * len(rows[-1][4])
        yield from solved()

    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select(*t, "side", "node", "component", "n", "s").repartition(parts, *t).sortWithinPartitions(*t, "side", "node")
    return dealt.mapInArrow(tidy(run), "tile long, u long, v long")


def _star_rows(pairs: DataFrame) -> DataFrame:
    """(t0, t1, t2, side, node, component) for pairs (hub, node): a star in parts of about STAR members."""
    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("c"))
    parts = F.ceil(F.col("c") / STAR).cast("long")
    dealt = pairs.join(counts, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), parts).alias("part"))
    key = [F.col("hub").alias("t0"), F.col("part").alias("t1"), F.lit(-1).cast("long").alias("t2")]
    members = dealt.select(*key, F.lit(1).alias("side"), "node")
    hubs = dealt.select(*key, F.lit(0).alias("side"), F.col("hub").alias("node")).distinct()
    return members.union(hubs).withColumn("component", F.col("node"))


def _fit(n: Column, each: float = BITS) -> Column:
    """How many sets a block of a tile holds whose greatest set has n shingles, of `each` bytes."""
    return F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), F.floor(F.lit(BLOCK_BYTES) / (n * each + 64))))


def _placed(rows: DataFrame, own: Column, others: Column) -> DataFrame:
    """(t0, t1, t2, side, node, component) for (tile, node, component): a row in each pair of its own and other blocks."""
    dealt = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(others))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.select(F.col("tile").alias("t0"), low.alias("t1"), high.alias("t2"), side.alias("side"), "node", "component")


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n.cast("int") - 1)


def _first_rows(rows: DataFrame) -> DataFrame:
    """For (tile, node, blocks): the first block of a tile against each block."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return _placed(rows.withColumn("component", F.col("node")), own, F.when(own == 0, _upto(F.col("blocks"))).otherwise(F.array(F.lit(0))))


def _per_tile(groups: DataFrame, *more: Column) -> DataFrame:
    """(tile, c, n, most) and more aggregates, of (tile, component, c, n)."""
    return groups.groupBy("tile").agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.max(F.struct("c", "component")).alias("most"), *more)


def _cuts(each: float = BITS) -> list[Column]:
    """rest, more and main of a tile (c, n, most): in how many blocks its greatest component, main, and all others lie."""
    fit, c, much = _fit(F.col("n"), each), F.col("c"), F.col("most.c")
    rest = F.when(c <= fit, 1).otherwise(F.ceil((c - much) / fit))
    return [rest.alias("rest"), F.when(c <= fit, 0).otherwise(F.ceil(much / fit)).alias("more"), F.col("most.component").alias("main")]


def _with_cuts(rows: DataFrame, each: float) -> DataFrame:
    """(tile, node, n, component) with their tile's rest, more and main."""
    groups = rows.groupBy("tile", "component").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    sizes, state = counted(_per_tile(groups).select("tile", *_cuts(each)))
    return lookup_join(rows, sizes, "tile", rows=state.rows)


def _further_rows(rows: DataFrame) -> DataFrame:
    """For (tile, node, n, component, rest, more, main): all blocks of a tile in pairs, but for those of its greatest
    component alone.

    The greatest component's blocks stand after the `rest` others; a tile that fits into one block is one.
    """
    last = (F.col("component") == F.col("main")) & (F.col("more") > 0)
    h = F.xxhash64("node")
    own = F.when(last, F.col("rest") + F.pmod(h, F.greatest("more", F.lit(1)))).otherwise(F.pmod(h, F.col("rest")))
    return _placed(rows, own, F.when(last, _upto(F.col("rest"))).otherwise(_upto(F.col("rest") + F.col("more"))))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("u", "v").alias("hub"), F.greatest("u", "v").alias("node")).distinct()


def _open_rows(rows: DataFrame, tiles: DataFrame, reached: DataFrame) -> DataFrame:
    """(tile, node, n, component, rest, more, main) of those tiles that hold several components; of tiles with the same sets
    one is enough. Which tiles those are and how they are cut comes to the rows in one join."""
    tiles, state = counted(tiles)
    rows = lookup_join(rows, tiles, "tile", rows=state.rows).join(reached, "node", "left")
    rows = cut(rows.select("tile", "a", "node", "n", F.coalesce("component", "node").alias("component")))
    groups = rows.groupBy("tile", "component").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.bit_xor(F.xxhash64("a")).alias("x"))
    still = _per_tile(groups, F.count(F.lit(1)).alias("parts"), F.bit_xor("x").alias("x")).where("parts > 1")
    still = still.groupBy("c", "x").agg(F.min(F.struct("tile", "n", "most")).alias("one")).select("c", "one.*")
    still, state = counted(still.select("tile", *_cuts()))
    return lookup_join(rows, still, "tile", rows=state.rows).drop("a")


def _gathered(rows: DataFrame) -> DataFrame:
    """(tile, node, n, component) with fewer tiles: those that share nodes become one where a block holds all their nodes, so
    a set goes there once; larger ones stay as they are."""
    first, state = counted(rows.groupBy("tile").agg(F.min("node").alias("_least")))
    edges = lookup_join(rows, first, "tile", rows=state.rows).select(F.col("node").alias("u"), F.col("_least").alias("v"))
    home, state = counted(components(edges))
    rows = lookup_join(rows, home.withColumnRenamed("component", "home"), "node", rows=state.rows)
    nodes = rows.select("home", "node", "n").distinct().groupBy("home").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"))
    small, state = counted(nodes.where(F.col("c") <= _fit(F.col("most"), ARRAYS)).select("home", F.lit(True).alias("_one")))
    rows = lookup_join(rows, small, "home", "left", rows=state.rows)
    return rows.select(F.when(F.col("_one"), F.col("home")).otherwise(F.col("tile")).alias("tile"), "node", "n", "component").distinct()


def link(documents: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row: the least id reachable by links of `percent` Jaccard."""
    shared_dir(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held: list[str] = []
    who = stored(identities(docs, k), held)
    named = who.where("a IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"), F.first("s").alias("s")), held)
    names, bits = classes.select("node", "a"), classes.select("node", "n", "s")

    def near_pairs(placed: DataFrame) -> DataFrame:
        """(tile, u, v) that the bitmaps let pass."""
        return cut(_solve(placed.join(bits, "node"), percent, False))

    def exact_links(placed: DataFrame) -> tuple[DataFrame, int]:
        """(tile, u, v) that link, found from the sets themselves where they lie together; fewer than the rows placed."""
        placed = cut(placed)
        nodes, state = counted(placed.select("node").distinct().join(names, "node"))
        found, count = counted(_solve(placed.join(_arrays(docs, nodes, k, state.rows), "node"), percent, True))
        return found, count.rows

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (hub, node) that link, but for those that others of a hub's pairs make needless."""
        rows = cut(_star_rows(pairs))
        nodes, state = counted(rows.select("node").distinct().join(names, "node"))
        return cut(_solve(rows.join(_arrays(docs, nodes, k, state.rows), "node"), percent, True)).select("u", "v")

    shared = shared_tiles(docs.where("doc_id IS NOT NULL"), k, percent)
    members = cut(shared.join(classes.select("node", "a", "n"), "a").select("tile", "a", "node", "n"))
    found = members.groupBy("tile").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("a")).alias("x"), F.max("n").alias("n"))
    blocks = F.ceil(F.col("c") / _fit(F.max("n"))).cast("int")
    tiles, state = counted(found.groupBy("c", "x").agg(F.min("tile").alias("tile"), blocks.alias("blocks")), F.max("blocks").alias("most"))
    near = near_pairs(_first_rows(lookup_join(members, tiles.select("tile", "blocks"), "tile", rows=state.rows)))
    true = linked(_pairs(near))
    links, reached = true, components(true)
    if (state.most or 0) > 1:
        more = near_pairs(_further_rows(_open_rows(members, tiles.where("blocks > 1").select("tile"), reached)))
        true = linked(_pairs(more))
        near, links = near.union(more), cut(links.union(true))
        reached = components(links)
    # Tiles in which the exact test refused a pair: others may have been skipped for it, so all of what is still in several
    # components is tested, where the sets lie together; only links come out of that.
    pair = [F.least("u", "v").alias("hub"), F.greatest("u", "v").alias("node")]
    refused, state = counted(near.select("tile", *pair).join(links.select(*pair), ["hub", "node"], "left_anti").select("tile").distinct())
    if state.rows:
        rows = cut(_open_rows(members, refused, reached))
        touched = _solve(_further_rows(rows).join(bits, "node"), percent, False, touched=True)
        rows = cut(rows.join(touched.select("tile", F.col("u").alias("node")).distinct(), ["tile", "node"]))
        more, count = exact_links(_further_rows(_with_cuts(_gathered(rows), ARRAYS)))
        reached = components(links.union(more.select("u", "v"))) if count else reached
    of = classes.join(reached, "node", "left").select("a", "b", F.coalesce("component", "node").alias("least"), "node", "rows").where("rows > 1 OR least <> node")
    of, state = counted(of.select("a", "b", "least"))
    out = lookup_join(who.drop("s"), of, ["a", "b"], "left", rows=state.rows)
    out = cut(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")))
    discard(documents.sparkSession, held)
    return out


#: For op7 with k = 3 and 90 percent, on tables without repeated ids. All pairs that share a shingle: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT v, least FROM reached JOIN links ON u = doc_id WHERE least < v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(least) FROM reached r WHERE r.doc_id = sets.doc_id) AS component_id FROM sets
"""
