"""Vocabularies, ordinals of hot groups, masks as runs, exact sums and states, stored joins, missing texts, file commits."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquill import providers
from terraquill.functions import kernels
from terraquill.operators import evaluate, ordinal, prompts, spatial, vocabulary
from terraquill.plans import pipeline
from terraquill.sinks import files
from terraquill.sources.fixtures import captions, detections, table

SF = "/root/testdata/sf0.001"


# Vocabularies


def test_terms_of_several_vocabularies_in_one_or_several_automata(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcABé ") for _ in range(n))
    rows = [(i, text(r.randint(0, 60))) for i in range(300)] + [(300, None), (301, ""), (302, "x" * 100_000 + "abab")]
    terms = [(v, t, i) for v in ("one", "two") for i, t in enumerate({text(r.randint(1, 4)).lower() for _ in range(150)})]
    known = spark.createDataFrame([*terms, ("one", "", 999), ("two", None, 5), ("one", "ab", 1000), ("one", "ab", 1001)], "vocabulary string, term string, ord long")
    least = {}
    for v, t, i in [*terms, ("one", "", 999), ("one", "ab", 1000)]:
        least[v, t] = min(i, least.get((v, t), i))
    df = spark.createDataFrame(rows, "id long, text string").withColumn("hits", F.lit("clash")).drop("hits").repartition(3)
    plain = {i: None if t is None else sorted((v, o, term) for (v, term), o in least.items() if term in t.lower()) for i, t in rows}
    for most in (vocabulary.MOST_BYTES, 200):
        got = vocabulary.with_hits(df, F.col("text"), known, most_bytes=most)
        assert got.columns == ["id", "text", "hits"]
        found = {x["id"]: None if x["hits"] is None else [(h["vocabulary"], h["ord"], h["term"]) for h in x["hits"]] for x in got.collect()}
        assert found == plain
    assert vocabulary.with_hits(df, F.col("text"), known.where("false")).where("size(hits) > 0").count() == 0
    assert vocabulary.with_hits(df.where("false"), F.col("text"), known).count() == 0


def test_captions_are_scanned_once(spark):
    plan = evaluate.quality(captions(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1 and "Contains" not in plan


# Ordinals


@pytest.mark.parametrize("hot", [100, 1000, 10**6])
def test_hot_groups_are_numbered_in_blocks(spark, hot):
    r = random.Random(hot)
    rows = [("a", r.randint(0, 5000)) for _ in range(6000)] + [("b", 7) for _ in range(2500)] + [(None, r.randint(0, 9)) for _ in range(300)] + [(f"c{i % 40}", i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, at long").withColumn("_extra", F.lit(1)).repartition(7)
    got = ordinal.numbered(df, ["k"], ["at"], "n", hot)
    assert got.columns == ["k", "at", "_extra", "n"] and dict(got.dtypes)["n"] == "bigint"
    seen = {}
    for x in got.collect():
        seen.setdefault(x["k"], []).append((x["n"], x["at"]))
    for k, own in seen.items():
        want = sorted(a for key, a in rows if key == k)
        assert [n for n, _ in sorted(own)] == list(range(1, len(want) + 1)) and [a for _, a in sorted(own)] == want
    assert len(seen) == 43


def test_no_task_holds_a_hot_group(spark):
    """A million rows of one image are dealt out; numbers equal the rows' own places."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(5).alias("image_id"), (F.col("id") * 48271 % 1_000_003).alias("at"))
    got = ordinal.numbered(df, ["image_id"], ["at"], "n", hot=50_000)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in sizes) == n
    state = got.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(state) == (1, n, n)
    pairs = got.select("n", "at").where("n % 1000 = 0").orderBy("n").collect()
    assert [x["at"] for x in pairs] == sorted(x["at"] for x in pairs)
    plan = ordinal.by_blocks(df, ["image_id"], ["at"], "n", 40)
    blocks = plan.groupBy("image_id").count().first()["count"]
    assert blocks == n


def test_reports_come_in_chunks(spark):
    seen = evaluate.observations(captions(spark, SF))
    rows = evaluate.report(seen, 7).orderBy("model_key", "chunk_no").collect()
    assert max(r["n_images"] for r in rows) == 7
    for key in {r["model_key"] for r in rows}:
        own = [r for r in rows if r["model_key"] == key]
        want = [f"{x['image_id']}:{x['keyword_count']}:{x['word_count']}" for x in seen.where(F.col("model_key") == key).orderBy("image_id").collect()]
        assert ",".join(r["results"] for r in own).split(",") == want and [r["first"] for r in own] == [7 * i for i in range(len(own))]


# Masks


def test_run_masks_equal_pixels(spark):
    r = np.random.default_rng(3)
    shapes = [r.random((9, 13)) > p for p in (0.2, 0.5, 0.9)] + [np.ones((9, 13), bool), np.zeros((9, 13), bool), np.eye(9, 13, dtype=bool)]
    pixels = [("im", i, int(x), int(y), 0.75 if m[y, x] else 0.5) for i, m in enumerate(shapes) for y in range(9) for x in range(13)]
    df = spark.createDataFrame(pixels + pixels[:50], "image_name string, det_idx long, x long, y long, v double")
    plain = sorted(map(tuple, spatial.mask_geometry(df.distinct()).collect()))
    masks = spatial.run_masks(df, 13)
    assert sorted(map(tuple, spatial.run_geometry(masks).collect())) == plain and len(plain) == 5
    flat = [(i, [int(len(list(g))) for g in _alternating(m.ravel())]) for i, m in enumerate(shapes)]
    stored = spark.createDataFrame(flat, "det_idx long, counts array<int>").select(F.lit("im").alias("image_name"), "det_idx", F.lit(13).alias("width"), spatial.counts_runs(F.col("counts")).alias("runs"))
    assert sorted(map(tuple, spatial.run_geometry(stored).collect())) == plain


def _alternating(bits):
    """Runs of equal bits, outside first."""
    runs, at, now = [], 0, False
    while at < len(bits):
        end = at
        while end < len(bits) and bits[end] == now:
            end += 1
        runs.append(bits[at:end])
        at, now = end, not now
    return runs


def test_a_large_mask_is_one_row(spark):
    """A mask of 10^9 pixels in one run."""
    row = spark.range(1).select(F.lit("im").alias("image_name"), F.lit(0).alias("det_idx"), F.lit(200_000).alias("width"), spatial.box_runs(spatial.line_runs(F.array(F.lit(5))), F.lit(10), F.lit(12), F.lit(200_000).cast("long")).alias("runs"))
    assert tuple(spatial.run_geometry(row).first()) == ("im", 0, 5, 11, 3)
    wide = spark.createDataFrame([("im", 1, 200_000, [(0, 10**9)])], f"image_name string, det_idx int, width int, runs {spatial.RUNS}")
    assert tuple(spatial.run_geometry(wide).first()) == ("im", 1, 99_999, 2_499, 10**9)


# Exact sums and states


def test_averages_do_not_depend_on_partitions(spark):
    r = random.Random(4)
    rows = [(f"m{i % 3}", i % 17 == 0, r.random() * 10 ** r.randint(-6, 6), r.random(), r.randint(0, 9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "model_key string, is_error boolean, inference_time double, overall double, keyword_count long")
    seen = {tuple(sorted(map(tuple, evaluate.partial(df.repartition(n)).collect()))) for n in (1, 8, 200)}
    assert len(seen) == 1


def test_batches_merge_to_the_whole(spark, tmp_path):
    seen = evaluate.observations(captions(spark, SF)).cache()
    folder = f"file://{tmp_path}/state"
    for name, rows in (("a", seen.where("image_id < 50")), ("b", seen.where("image_id >= 50")), ("b", seen.where("image_id >= 50"))):
        state = evaluate.add_batch(folder, name, rows)
    for options in ({}, {"failed": ("internvl2_4b",)}, {"count_errors": False}):
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(evaluate.summary_of(state, **options)) == key(evaluate.summary(seen, **options))
    assert evaluate.summary(seen.where("false")).collect() == []


def test_errors_weigh_as_zeros_or_not_at_all(spark):
    rows = [("qwen2vl_2b", False, 3.0, 0.5, 4), ("qwen2vl_2b", True, 0.0, 0.0, 0), ("internvl2_4b", True, 0.0, 0.0, 0)]
    seen = spark.createDataFrame(rows, "model_key string, is_error boolean, inference_time double, overall double, keyword_count long")
    mean = lambda **o: {r["model"]: (r["avg_time_s"], r["avg_quality"], r["avg_keywords"]) for r in evaluate.summary(seen, **o).collect()}
    assert mean() == {"qwen2vl_2b": (1.5, 0.25, 2.0), "internvl2_4b": (0.0, 0.0, 0.0)}
    assert mean(count_errors=False) == {"qwen2vl_2b": (3.0, 0.5, 4.0)}


# Prompts


def test_stored_captions_are_not_shuffled_again(spark, tmp_path):
    said = captions(spark, SF).select("image_id", "caption")
    stored = prompts.co_located(said, detections(spark, SF), f"file://{tmp_path}", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = prompts.combined(stored)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = prompts.prompts(said, detections(spark, SF))
        assert sorted(map(tuple, rows.select("image_id", "prompt").collect())) == sorted(map(tuple, want.select("image_id", "prompt").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prompts_with_missing_parts(spark):
    rows = [("Cap", "3 car", 3, "3 car"), (None, "3 car", 3, "3 car"), ("Cap", None, 3, "3 car"), ("Cap", None, 3, None), ("Cap", "3 car", 3, None), (None, "", 0, ""), ("Cap", "", 5, "x"), ("Cap", "3 car", 0, "x"), ("Cap", "3 car", None, "")]
    df = spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], "image_id long, caption string, counts_text string, total long, summary string, spatial_description string")
    got = [r["prompt"] for r in prompts.combined(df).orderBy("image_id").collect()]
    assert got[0].startswith("Satellite photograph of cap with 3 car. 3 car. Real") and got[8].startswith("Satellite photograph of cap with 3 car. Real")
    assert got[1:8] == ["Aerial view: None, 3 car", "Aerial view: Cap, 3 car", "Aerial view: Cap", "Aerial view: Cap", "Aerial view: None", "Aerial view: Cap", "Aerial view: Cap"]


def test_unlocated_detections_in_one_pass(spark):
    sure = detections(spark, SF)
    rest = spatial.unlocated(sure).select("image_id", "det_idx")
    want = sure.join(spatial.located(sure).select("image_id", "det_idx"), ["image_id", "det_idx"], "left_anti").select("image_id", "det_idx")
    assert sorted(map(tuple, rest.collect())) == sorted(map(tuple, want.collect()))
    assert rest._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


# Files


def _metadata(spark, n=40):
    name = F.concat(F.lit("image_"), F.col("doc_id").cast("string"))
    made = pipeline.metadata(name, name, F.col("lang"), F.substring("text", 1, 50))
    return table(spark, SF, "documents").limit(n).repartition(4).select(name.alias("image_name"), made.alias("metadata"))


def test_files_are_seen_when_all_are_written(spark, tmp_path):
    made = _metadata(spark).cache()
    folder = tmp_path / "metadata"
    files.write_metadata(made, f"file://{folder}")
    files.write_metadata(made, f"file://{folder}")  # again: the same files
    want = {r["image_name"] + ".json": json.loads(r["m"]) for r in made.select("image_name", F.to_json("metadata").alias("m")).collect()}
    assert {f: json.loads((folder / f).read_text()) for f in os.listdir(folder)} == want and len(want) == 40


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "metadata"
    spark.dataSource.register(files.TextFiles)
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.lit("text")).cast("string").alias("text"))
    with pytest.raises(Exception, match="broken row"):
        rows.write.format("text_files").mode("append").option("path", f"file://{folder}").save()
    assert not folder.exists() or [f for f in os.listdir(folder) if not f.startswith(".")] == []


def test_a_model_is_opened_once_a_task(spark, tmp_path):
    """Many Arrow batches in a task: the model is opened and closed once, and asked for a batch at a time."""
    log = tmp_path / "log"

    class Counting(providers.DetailCaptioner):
        def _note(self, what):
            with open(log, "a") as f:
                f.write(what + "\n")

        def open(self):
            self._note("open")
            super().open()

        def predict(self, rows):
            self._note(f"predict {len(rows)}")
            return super().predict(rows)

        def close(self):
            self._note("close")
            super().close()

    image = kernels.png(np.full((4, 4, 3), 9, np.uint8))
    pixels = np.full((4, 4, 3), 9, np.uint8).tobytes()
    rows = [(f"o{i}", f"n{i}", 4, 4, 3, pixels) for i in range(20)]
    decoded = spark.createDataFrame(rows, "origin string, image_name string, height int, width int, n_channels int, data binary").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = providers.benchmark(decoded, {"a": Counting, "b": Counting}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    said = log.read_text().split("\n")
    assert image and len(got) == 40 and said.count("open") == said.count("close") == 2 and said.count("predict 5") == 8
