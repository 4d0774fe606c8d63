"""Centroid clustering, periodic runs and token chunks against brute force or the library itself, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terraquill.llm import bpe, jaccard, queries, runs, textkit, tokens, yinyang
from terraquill.llm.runtime import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Clustering


def lloyd(rows, k, rounds, scale, seed):
    """(id, cluster, distance) of (id, integers) rows by plain rounds over all distances, and the centroids."""
    x = [[int(np.floor(scale * c)) for c in v] for _, v in rows]
    order = sorted(range(len(x)), key=lambda r: (sha(f"{seed}:{rows[r][0]}"), x[r]))
    c = [list(x[r]) for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        for j in range(len(c)):
            mine = [v for v, o in zip(x, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((rows[r][0], nearest(v)[1], nearest(v)[0]) for r, v in enumerate(x)), c


@pytest.mark.parametrize("k,groups", [(1, 1), (5, 2), (12, 4), (12, 12)])
def test_clusters_equal_plain_rounds(spark, k, groups):
    r = random.Random(k)
    rows = [(i, [r.choice([-1, 0, 0.5, r.random()]) + (i % 4) * 0.7 for _ in range(3)]) for i in range(400)]
    rows += rows[:20]  # repeated rows, ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, centroids = yinyang.fit(df, k, 6, 3, 16, 3, groups)
    want, c = lloyd(rows, k, 6, 16, 3)
    assert sorted(map(tuple, got.collect())) == want and centroids.tolist() == c


def test_bounds_spare_distances_and_change_nothing():
    r = np.random.default_rng(4)
    heads = r.integers(-900, 900, (20, 16))
    x = (heads[r.integers(0, 20, 5000)] + r.integers(-60, 60, (5000, 16))).astype(np.int64)
    m = yinyang.Model(x[:20].copy(), 4)
    own, upper, lower = m.first(x)
    work = []
    for _ in range(6):
        m.to(np.array([x[own == j].sum(axis=0) // max(1, (own == j).sum()) for j in range(20)]))
        own, upper, lower, n = m.step(x, own, upper, lower)
        plain = np.stack([yinyang.squared(x, c) for c in m.c], axis=1)
        assert (own == plain.argmin(axis=1)).all()
        work.append(n)
        near = np.sqrt(plain[np.arange(len(x)), own])
        plain[np.arange(len(x)), own] = np.iinfo(np.int64).max
        assert (upper >= near).all() and all((lower[:, g] <= np.sqrt(plain[:, at].min(axis=1).astype(float))).all() for g, at in enumerate(m.groups))
    assert work[-1] < 0.2 * x.shape[0] * 20


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1e300, -1e300]), (None, [0.5, 0.5]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash"))
    got = {r["vec_id"]: r for r in yinyang.cluster(df, k=8, rounds=3, width=2, groups=2).collect()}
    assert set(got) == {1, 7, None} and all(r["distance"] == 0 for r in got.values()) and sorted(r["cluster"] for r in got.values()) == [0, 1, 2]
    assert got[None]["cluster"] == 2
    empty = yinyang.cluster(df.where("false"), width=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# Runs


def brute_runs(w, least=6, periods=4):
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, periods * q):
                out.setdefault((start, i - start + q), q)  # the least period comes first
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(3000):
        letters, w = r.choice(["a", "ab", "abc", "abcd"]), []
        while len(w) < r.choice([5, 10, 40, 80]):
            w += [r.choice(letters) for _ in range(r.randint(1, 6))] * r.choice([1, 1, 2, 4, 5, 9])
        w = w[:120]
        assert runs.word_runs(w) == brute_runs(w), w
        assert sorted(runs._found(np.array([ord(c) for c in w]), 6, 4)) == sorted(brute_runs(w))  # without the cover


def test_extensions_are_verified_whatever_the_hash_says(monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(runs.Extensions, "_alike", lambda self, i, j, size: True)  # a hash that always collides
    w = np.array([r.choice([0, 0, 1]) for _ in range(300)])
    for _ in range(2000):
        i, j = sorted(r.sample(range(300), 2))
        ext = runs.Extensions(w)
        n = next((x for x in range(300 - j) if w[i + x] != w[j + x]), 300 - j)
        m = next((x for x in range(i) if w[i - x - 1] != w[j - x - 1]), i)
        assert (ext.right(i, j), ext.left(i, j)) == (n, m)


def test_long_texts_are_linear_enough():
    for unit, times in (("x", 200_000), ("abcabca", 30_000), ("abaa", 40_000)):
        assert runs.word_runs(list(unit) * times) == [(0, len(unit) * times, len(unit))]


def expected_runs(i, t):
    w = WORD.findall(t or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    number = {}
    coded = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    found = {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (coded[:-q] == coded[q:]).astype(int), [0]])
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if e - s + q >= max(6, 4 * q):
                found.setdefault((s, e - s + q), q)
    rs = sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))
    out = {x for s, length, q in rs for x in range(s + q, s + length)}
    top = min(rs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = " ".join(x for k, x in enumerate(w) if k not in out)
    return (i, len(rs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{a},{q}\n" for s, a, q in rs)), sha(kept))


def test_runs_of_the_whole_table(spark):
    got = queries.QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = sorted(expected_runs(*r) for r in rows)
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 5


ODD = [None, "", " \t\n", "one", "a b c d e", "la la la la la la", "la la la la la", "La la la la la la la", "x y " * 50_000, "           ", "\x00 \x00 \x00 \x00 \x00 \x00 é", "x" * 70_000]


def test_runs_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + ODD[5:6])], DOC).withColumn("n", F.lit(1))
    df = df.union(df.where("doc_id = 5")).withColumn("runs", F.lit("clash"))
    assert sorted(map(tuple, runs.digest(df).collect())) == sorted([expected_runs(i, t) for i, t in enumerate(ODD + ODD[5:6])] + [expected_runs(5, ODD[5])])
    found = {r["doc_id"]: r for r in runs.detect(df).collect()}
    assert [tuple(x) for x in found[5]["runs"]] == [(0, 6, 1)] and found[5]["collapsed"] == "la" and found[6]["runs"] == [] and found[0]["collapsed"] == ""
    assert [tuple(x) for x in found[7]["runs"]] == [(1, 6, 1)] and found[5]["n"] == 1
    assert runs.digest(df.where("false")).collect() == []
    alone = runs.digest(spark.createDataFrame([(None, ODD[5])], DOC)).first()
    assert alone["doc_id"] is None and alone["n_runs"] == 1


# Token chunks


def library(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return [(len(i), sha(np.array(i, "<u4").tobytes()), sha(d)) for i, d in zip(ids, t.decode_batch(ids, skip_special_tokens=False))]


def test_tokens_of_the_whole_table(spark):
    got = queries.QUERIES["op13_bpe_encoding"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect())) == sorted((r[0], *x) for r, x in zip(rows, library(WORDS, [r[1] for r in rows])))


STRANGE = [chr(i) for i in range(0x180)] + list("'''   \n\ņ́각ÅẞΣ中 　😀") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "hello ", "World"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_tokens_of_odd_texts(spark, path):
    r = random.Random(8)
    passage = "".join(r.choice(STRANGE) for _ in range(3000)) + " ".join(r.choice(["Shared", "passage's", "words", "élan", "12,5"]) for _ in range(900))
    texts = [None, "", " ", "\n", "a", "x" * 70_000, "0123456789abcdef" * 5000, " ".join(["word"] * 30_000), "<|endoftext|> a<|endoftext|>b", "é" * 9000, "\x1c a\x85b\xa0c"]
    texts += ["".join(r.choice(STRANGE) for _ in range(r.randint(0, 80))) for _ in range(600)]
    texts += [STRANGE[r.randrange(len(STRANGE))] * r.randint(0, 3) + passage[r.randint(0, 400) : r.randint(2000, 9000)] + r.choice(["", " tail", "tail"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("ids", F.lit("clash")).repartition(5)
    coded = bpe.encode(df.union(df.where("doc_id < 9")), path, bits=6)
    found = coded.select("doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    want = [(i, *x) for i, x in enumerate(library(path, texts))]
    assert sorted(map(tuple, found)) == sorted(want + want[:9])
    assert bpe.digest(df.where("false"), path).collect() == []


def test_shared_chunks_are_encoded_once_and_joins_repaired(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 9)))
    passage = " ".join(word() for _ in range(2000))
    texts = [" ".join(word() for _ in range(50)) + r.choice([" ", "", "\n"]) + passage + r.choice(["x", " y"]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4)
    known = bpe.dictionary(df, "text", WORDS)
    assert 0.8 * len(passage) < sum(map(len, known)) <= len(passage) and all(b.decode() in passage for b in known)
    coder = bpe.Coder(WORDS)
    parts = next(bpe._pieces(*next(textkit.chunks(df.limit(1).toArrow().column("text")))[2:], bpe.BITS, known))
    assert sum(len(p) for p in parts if isinstance(p, str)) < 0.3 * len(texts[0])
    assert all(coder.tokenizer.encode(b.decode(), add_special_tokens=False).ids == np.frombuffer(i, "<u4").tolist() for b, i in known.items())
    few = bpe.dictionary(df, "text", WORDS, held=3000)
    assert few and sum(map(len, few)) <= 3000 and set(few) <= set(known)
    for held in (0, 3000, bpe.HELD):
        got = bpe.encode(df, WORDS, held=held).select("doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256), F.sha2("decoded", 256))
        assert sorted(map(tuple, got.collect())) == [(i, *x) for i, x in enumerate(library(WORDS, texts))]


def test_cuts_depend_on_content_only():
    r = np.random.default_rng(1)
    passage = r.integers(97, 123, 20_000).astype(np.uint8)
    ahead = r.integers(97, 123, 777).astype(np.uint8)
    cuts = textkit.content_cuts(passage, np.array([0, len(passage)]), 6)
    moved = textkit.content_cuts(np.concatenate([ahead, passage]), np.array([0, len(ahead) + len(passage)]), 6) - len(ahead)
    assert set(cuts[1:].tolist()) <= set(moved.tolist()) and 150 < len(cuts) < 600
    apart = textkit.content_cuts(np.concatenate([ahead, passage]), np.array([0, len(ahead), len(ahead) + len(passage)]), 6) - len(ahead)
    assert set(cuts.tolist()) == {x for x in apart.tolist() if x >= 0}


def test_vocabularies_without_apart_words_are_refused(tmp_path):
    import json

    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Coder(str(path))


# Jaccard join: groups just below the threshold


def _brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    home = list(range(len(texts)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                home[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_about_the_threshold_equal_brute_force(spark, seed):
    """Texts whose pairs lie just below, at and just above 0.9, in groups of different make."""
    r = random.Random(seed)
    texts = []
    for g in range(6):
        base = [f"w{g}_{i}" for i in range(r.choice([60, 150, 302]))]
        for k in range(40):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                t[r.randrange(len(t))] = f"x{r.randrange(30)}"
            texts.append(" ".join(t + [f"u{k}_{g}_{i}" for i in range(r.randint(0, len(base) // 18))]))
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(5)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.link(df, k=3, percent=90).collect()}
    want = _brute_groups(texts, 3, 90)
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < len(texts)


def test_rows_follow_texts_not_pairs_below_the_threshold(spark, monkeypatch):
    """None of the pairs links (0.898): what is kept on the way grows with the texts."""
    seen = []
    plain = jaccard.counted

    def noted(df, *more):
        out = plain(df, *more)
        seen.append(out[1].rows)
        return out

    monkeypatch.setattr(jaccard, "counted", noted)
    monkeypatch.setattr(jaccard, "cut", lambda df: noted(df)[0])
    most = {}
    for n in (200, 400, 800):
        texts = [" ".join([f"c{i}" for i in range(302)] + [f"u{k}_{i}" for i in range(17)]) for k in range(n)]
        seen.clear()
        rows = jaccard.link(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4), k=3, percent=90)
        assert rows.where("doc_id <> component_id").count() == 0
        most[n] = max(seen)
    assert most[400] < 2.2 * most[200] and most[800] < 2.2 * most[400]


def test_overlaps_of_a_block_equal_plain_intersections():
    r = np.random.default_rng(5)
    for _ in range(30):
        common = r.integers(0, 2**63, 50, dtype=np.uint64)
        sets = [np.unique(np.concatenate([common[r.random(50) < 0.95], r.integers(0, 60, r.integers(1, 20), dtype=np.uint64)])) for _ in range(r.integers(1, 40))]
        o = jaccard.Overlaps(sets)
        for i, x in enumerate(sets):
            assert np.delete(o.of(i), i).tolist() == [len(np.intersect1d(x, y)) for j, y in enumerate(sets) if j != i]


# Packing by tokens


def test_the_packing_query_by_tokens(spark):
    """The query's rows: op1's token counts, the least padding of any bounds, batches within the budget, places without gaps."""
    rows = queries.QUERIES["op8_packing"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    trie = tokens.Trie(tokens.read_vocabulary())
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: sum(trie.insert(w) for w in (t or "").split()) for i, t in docs.items()}
    sizes = sorted(r["n_tokens"] for r in rows)
    distinct = sorted(set(sizes))
    count = [sizes.count(x) for x in distinct]
    # The least padding by a plain programme over all bounds.
    best = [[0] + [float("inf")] * len(distinct)]
    for _ in range(16):
        now = [0] + [float("inf")] * len(distinct)
        for j in range(1, len(distinct) + 1):
            pad = 0
            for i in range(j, 0, -1):
                pad += count[i - 1] * (distinct[j - 1] - distinct[i - 1])
                now[j] = min(now[j], best[-1][i - 1] + pad)
        best.append(now)
    assert sum(r["padding"] for r in rows) == min(b[-1] for b in best[1:])
    batches = {}
    for r in rows:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"], r["bucket_len"]), []).append(r["place"])
    for (_, _, most), places in batches.items():
        assert sorted(places) == list(range(len(places))) and (len(places) * most <= 65536 or len(places) == 1)


def test_open_tiles_are_joined_to_their_rows_once(spark, monkeypatch):
    """Which tiles stay open and how they are cut into blocks comes in one join: after it none is needed to place rows."""
    members = spark.createDataFrame([(t, a, a, 20) for t, own in ((1, (1, 2, 3)), (2, (1, 2, 3)), (3, (1, 2)), (4, (2, 3))) for a in own], "tile long, a long, node long, n long")
    reached = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    joins, join = [], jaccard.lookup_join
    monkeypatch.setattr(jaccard, "lookup_join", lambda df, table, on, *a, **k: joins.append(on) or join(df, table, on, *a, **k))
    placed = jaccard._further_rows(jaccard._open_rows(members, members.select("tile").distinct(), reached))
    assert sorted((r.t0, r.t1, r.t2, r.side, r.node, r.component) for r in placed.collect()) == [(1, 0, 0, 2, n, c) for n, c in ((1, 1), (2, 1), (3, 3))] + [(4, 0, 0, 2, n, c) for n, c in ((2, 1), (3, 3))]
    assert joins == ["tile", "tile"]
