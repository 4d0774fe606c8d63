"""Each stage against brute force on a small fixture, and the whole run."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests_llm_support import brute_kept
from terraquill.llm import decontam, pii

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("theinganor") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(40)]
    texts += [t + " " + word() for t in texts[:10]] + [texts[3], None, "", "123 456", "mail a.b@x.org now please write again"]
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[5]], DOC)


def test_stages(spark, docs):
    first = pipeline.identify_language(spark, docs, SF)
    assert first.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in first.collect()}
    assert gone == {51, 52, 53} and all(r["lang"] for r in first.collect())
    second = pipeline.drop_near_duplicates(spark, first, SF)
    kept = sorted(r["doc_id"] for r in second.collect())
    assert kept == brute_kept({r["doc_id"]: r["text"] for r in first.collect()}, 5, 80)
    third = pipeline.decontaminate(spark, second, SF)
    assert sorted(r["doc_id"] for r in third.collect()) == kept and third.columns == docs.columns
    fourth = {r["doc_id"]: r for r in pipeline.mask_personal_data(spark, third, SF).collect()}
    model = pii.fit()
    for r in third.collect():
        base, added = pii.find(r["text"], model)
        spans = [(k, a, b) for k in pii.KINDS for a, b in base[k]] + added
        assert fourth[r["doc_id"]]["text"] == pii.masked(r["text"], spans)
    assert fourth[54]["text"].startswith("mail <EMAIL> now") and fourth[54]["n_chars"] == len(fourth[54]["text"])


def test_language_stays_null_for_a_script_not_learned(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the words of one language", "en")] * 9 + [("the words of this", None), ("これはペンです", None)])]
    got = {r["doc_id"]: r["lang"] for r in pipeline.identify_language(spark, spark.createDataFrame(rows, DOC), SF).collect()}
    assert got[9] == "en" and got[10] is None and len(got) == 11


def test_contaminated_documents_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    docs = spark.createDataFrame([(1, f"before {item['text']} after", "en", "s", 1), (2, "clean words stay here", "en", "s", 1)], DOC)
    assert [r["doc_id"] for r in pipeline.decontaminate(spark, docs, SF).collect()] == [2]
    assert decontam.words_of(item["text"])


def test_rows_with_null_or_repeated_ids_are_decided_alone(spark):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("theinganor") for _ in range(6)) for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, a), (None, a + " more"), (4, a), (7, b), (7, c), (6, b), (None, d), (None, d + " more"), (8, None), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOC)
    kept = sorted(((x["doc_id"], x["text"]) for x in pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert [x for x in kept if x[1] and x[1].startswith(d)] in ([(None, d)], [(None, d + " more")])
    assert [x for x in kept if not (x[1] and x[1].startswith(d))] == sorted([(4, a), (6, b), (7, c), (8, None), (None, None)], key=str)
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in [(None, item), (None, a), (3, item), (3, b)]], DOC)
    assert sorted((x["text"] for x in pipeline.decontaminate(spark, docs, SF).collect())) == sorted([a, b])


CLASH = ("_key", "Score", "lang_pred", "spans", "masked", "n_email", "n", "_group", "component_id", "tile", "a", "base_sha256", "_first")


@pytest.mark.parametrize("repeated", [False, True])
def test_columns_with_clashing_names_and_very_long_texts(spark, docs, repeated):
    long = " ".join(f"word{i} a.b{i}@x.org" if i % 50 == 0 else f"other{i}" for i in range(60_000))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(100, long, None, "s", len(long)), (101, "y" * 300_000 + " end", "en", None, None), (102, long + " " + item, "en", "s", 1)]
    own = docs.dropDuplicates(["doc_id"]).union(spark.createDataFrame(rows, DOC))
    own = own.union(own.where("doc_id = 100")) if repeated else own
    for c in CLASH:
        own = own.withColumn(c, F.concat(F.lit(f"{c}-"), "doc_id"))
    kept = own
    for _, stage in pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == own.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    assert 100 in got and 101 in got and kept.where("doc_id = 100").count() == 1
    assert all(r[c] == f"{c}-{i}" for i, r in got.items() for c in CLASH)
    assert got[100]["text"].count("<EMAIL>") == 1200 and "@" not in got[100]["text"] and got[100]["n_chars"] == len(got[100]["text"])
    assert 102 not in got  # a near copy of 100


@pytest.mark.parametrize("repeated", [False, True])
def test_columns_of_any_type(spark, docs, repeated):
    """Maps, structs, arrays and bytes go through all stages; exact repetitions are told by all of them."""
    extra = {
        "tags": F.create_map(F.lit("k"), F.col("doc_id").cast("string")), "none": F.lit(None).cast("map<string,array<int>>"), "raw": F.encode("lang", "UTF-8"),
        "nested": F.struct(F.array(F.create_map(F.lit(1), F.lit(2.5))).alias("m"), "source"), "when": F.lit("2024-01-02").cast("date"),
    }
    own = docs.dropDuplicates(["doc_id"]).withColumns(extra)
    if repeated:
        own = own.union(own.where("doc_id IN (20, 54)")).union(own.where("doc_id = 20").withColumn("tags", F.create_map(F.lit("k"), F.lit("other"))).withColumn("text", F.lit("a text of its own")))
    kept = own
    for _, stage in pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF).cache()
        assert kept.dtypes == own.dtypes
    rows = kept.where("doc_id = 20").collect()
    assert sorted(r["tags"]["k"] for r in rows) == (["20", "other"] if repeated else ["20"]) and kept.where("doc_id = 54").count() == 1
    assert pipeline.pack_batches(spark, kept, SF).count() == kept.count()


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


def test_empty(spark, docs):
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
