"""Queries by name; each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill import vocab
from terraquill.functions import expr, kernels
from terraquill.operators import detect, evaluate, prompts, spatial, vocabulary
from terraquill.operators.shared import shared_folder
from terraquill.plans import pipeline
from terraquill.sources import images
from terraquill.sources.fixtures import captions, detections, page_images, table
from terraquill.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SCORES = ("length", "quantification", "spatial", "structures", "overall")
MEANS = ("avg_time_s", "avg_quality", "avg_keywords", "combined_score")


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


# Captions


@query
def caption_quality(spark, sf):
    return rounded(evaluate.quality(captions(spark, sf)).select("image_id", "word_count", "number_count", *SCORES), *SCORES)


def _hits(spark, sf, lists=None):
    known = vocabulary.of_lists(spark, lists or {"keywords": vocab.AERIAL_KEYWORDS})
    return vocabulary.with_hits(captions(spark, sf).select("image_id", "caption"), F.col("caption"), known)


@query
def keyword_hits(spark, sf):
    return _hits(spark, sf).select("image_id", vocabulary.hit_count(F.col("hits"), "keywords").alias("keyword_count"))


@query
def keyword_list(spark, sf):
    return _hits(spark, sf).select("image_id", F.array_join(vocabulary.hits_of(F.col("hits"), "keywords"), ",").alias("keywords"))


@query
def vocab_match(spark, sf):
    rows = _hits(spark, sf).select("image_id", F.explode(vocabulary.hits_of(F.col("hits"), "keywords")).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n_captions"))


@query
def vocabulary_terms(spark, sf):
    """A vocabulary that is a table: the words of at least six letters of all test items, in every document."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where(F.char_length("term") >= 6).distinct()
    known = words.select(F.lit("items").alias("vocabulary"), "term", F.lit(0).cast("long").alias("ord"))
    rows = vocabulary.with_hits(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), known)
    return rows.select("doc_id", F.size("hits").cast("long").alias("n_terms"), F.array_min(F.transform("hits", lambda h: h["term"])).alias("first_term"))


@query
def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", expr.word_count(F.col("text")).alias("word_count"))


@query
def token_budget(spark, sf):
    words = word_counts(spark, sf).withColumn("est_tokens", expr.token_estimate(F.col("word_count")))
    return words.withColumn("fits", F.col("est_tokens") <= vocab.TOKEN_LIMIT)


@query
def quantification(spark, sf):
    rows = captions(spark, sf).select("image_id", expr.number_count(F.col("caption")).alias("number_count"))
    return rounded(rows.withColumn("quantification", expr.share(F.col("number_count"), 3)), "quantification")


@query
def clean_captions(spark, sf):
    return captions(spark, sf).select("image_id", expr.clean_caption(F.col("caption")).alias("caption"))


@query
def caption_preview(spark, sf):
    c = F.col("caption")
    return captions(spark, sf).select("image_id", *[expr.preview(c, n).alias(f"first_{n}") for n in (70, 100, 150, 200)], F.char_length(c).cast("long").alias("n_chars"))


@query
def error_captions(spark, sf):
    return captions(spark, sf).where("is_error").select("image_id", expr.failed_caption(F.col("caption")).alias("failed"), expr.error_caption(F.col("caption")).alias("error"))


@query
def output_paths(spark, sf):
    name = F.concat(F.lit("image_"), F.col("image_id").cast("string"))
    out = lambda folder, ending: expr.output_path("outputs", folder, name, ending)
    return captions(spark, sf).select("image_id", out("images", "_upscaled.png").alias("upscaled"), out("images", "_generated.png").alias("generated"), out("images", "_generated_control.png").alias("control"), out("metadata", ".json").alias("metadata"))


@query
def class_prompt(spark, sf):
    """The question of a detector that looks for the classes that are there, in the vocabulary's order."""
    there = _sure(spark, sf).agg(F.collect_set("label").alias("labels"))
    return there.select(expr.class_prompt(F.col("labels")).alias("class_prompt"))


@query
def assistant_reply(spark, sf):
    turn = F.struct("turn", F.concat_ws(" ", "role", "text").alias("t"))
    one = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    response = F.array_join(F.transform("turns", lambda x: x["t"]), " ")
    return one.select("conv_id", expr.assistant_reply(response).alias("reply"))


@query
def image_name(spark, sf):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", expr.file_name(path).alias("file_name"), expr.stem(path).alias("image_name"))


@query
def chat_messages(spark, sf):
    made = expr.chat(F.concat(F.lit("image_"), F.col("image_id").cast("string"), F.lit(".png")), "Describe this aerial image.")
    return captions(spark, sf).select("image_id", F.size(made[0]["content"]).cast("long").alias("n_parts"), made[0]["role"].alias("role"), made[0]["content"][0]["image"].alias("image"), made[0]["content"][1]["text"].alias("text"))


# Models


def _summary(spark, sf, **options):
    return evaluate.summary(evaluate.observations(captions(spark, sf)), **options)


@query
def observations(spark, sf):
    rows = evaluate.observations(captions(spark, sf)).select("image_id", "model_key", "is_error", "inference_time", "keyword_count", *SCORES)
    return rounded(rows, *SCORES, "inference_time")


@query
def benchmark_summary(spark, sf):
    return rounded(_summary(spark, sf), *MEANS)


@query
def benchmark_summary_failed(spark, sf):
    return rounded(_summary(spark, sf, failed=("internvl2_4b",)), *MEANS)


@query
def benchmark_summary_good_rows(spark, sf):
    return rounded(_summary(spark, sf, count_errors=False), *MEANS)


@query
def benchmark_summary_merged(spark, sf):
    """The summary of a state that two batches were added to, one of them twice."""
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    seen = evaluate.observations(captions(spark, sf))
    for batch, rows in (("even", seen.where("image_id % 2 = 0")), ("odd", seen.where("image_id % 2 = 1")), ("even", seen.where("image_id % 2 = 0"))):
        state = evaluate.add_batch(folder, batch, rows)
    return rounded(evaluate.summary_of(state), *MEANS)


@query
def model_ranking(spark, sf):
    return evaluate.ranking(rounded(_summary(spark, sf), *MEANS)).select("rank", "model", "combined_score")


@query
def best_model(spark, sf):
    return evaluate.best(rounded(_summary(spark, sf), *MEANS)).select("model", "model_name", "combined_score")


@query
def model_image_grid(spark, sf):
    keys = F.array(*[F.lit(m.key) for m in vocab.MODELS])
    return table(spark, sf, "documents").select(F.posexplode(keys).alias("model_ord", "model_key"), F.col("doc_id").alias("image_id")).withColumn("model_ord", F.col("model_ord").cast("long"))


@query
def model_results(spark, sf):
    return evaluate.report(evaluate.observations(captions(spark, sf)))


@query
def run_summary(spark, sf):
    return captions(spark, sf).agg(F.sum((~F.col("is_error")).cast("long")).alias("successful"), F.count(F.lit(1)).alias("total"))


# Detections


def _sure(spark, sf):
    return detect.confident(detections(spark, sf))


@query
def filter_detections(spark, sf):
    return _sure(spark, sf).select("image_id", "det_idx", "label", F.round("score", 9).alias("score"))


@query
def detections_long(spark, sf):
    item = F.struct("det_idx", "label", "score", "center_x", "center_y")
    arrays = detections(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("d"))
    point = lambda x: F.array(x["center_x"].cast("double"), x["center_y"].cast("double"))
    boxes = arrays.select(F.col("image_id").cast("string").alias("image_name"), F.transform("d", point).alias("boxes"), F.transform("d", lambda x: x["score"]).alias("scores"), F.transform("d", lambda x: x["label"]).alias("labels"))
    long = detect.long_form(boxes)
    return long.select(F.col("image_name").cast("long").alias("image_id"), "det_idx", "label", F.round("score", 9).alias("score"), F.col("box")[0].alias("x"), F.col("box")[1].alias("y"))


@query
def detection_counts(spark, sf):
    return detect.counts(_sure(spark, sf))


@query
def detection_totals(spark, sf):
    return detect.totals(_sure(spark, sf))


@query
def top3_labels(spark, sf):
    return detect.top_labels(_sure(spark, sf))


@query
def counts_text(spark, sf):
    return detect.texts(_sure(spark, sf)).select("image_id", "counts_text")


@query
def detection_summary(spark, sf):
    return detect.texts(_sure(spark, sf)).select("image_id", "summary", "total")


@query
def detection_counts_full(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id")).join(detect.texts(_sure(spark, sf)), "image_id", "left")
    return rows.select("image_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("counts_text", F.lit("")).alias("counts_text"), F.coalesce("summary", F.lit("")).alias("summary"))


# Space


def _located(spark, sf):
    return spatial.located(_sure(spark, sf))


@query
def grid_position(spark, sf):
    where = expr.grid_position(F.col("center_x"), F.col("center_y"), F.col("img_w"), F.col("img_h"))
    return _sure(spark, sf).select("image_id", "det_idx", where.alias("position"))


@query
def size_class(spark, sf):
    relative = expr.relative_size(F.col("area"), F.col("img_w"), F.col("img_h"))
    rows = _sure(spark, sf).select("image_id", "det_idx", relative.alias("relative_size"), expr.size_class(relative).alias("size_description"))
    return rounded(rows, "relative_size")


@query
def localize(spark, sf):
    rows = _located(spark, sf).select("image_id", "det_idx", "object", "position", "center_x", "center_y", "area", "relative_size", "size_description")
    return rounded(rows, "relative_size")


@query
def unlocalized(spark, sf):
    return spatial.unlocated(_sure(spark, sf)).select("image_id", "det_idx", "label")


@query
def position_counts(spark, sf):
    return spatial.position_counts(_located(spark, sf))


@query
def spatial_description(spark, sf):
    return spatial.descriptions(_located(spark, sf))


@query
def mask_geometry(spark, sf):
    """Every detection as a rectangle of pixels around its centre, some of them below the threshold, as runs of a line."""
    d = detections(spark, sf)
    side = F.col("det_idx") % 3
    inside = F.filter(F.sequence(F.col("center_x"), F.col("center_x") + side), lambda x: (x + F.col("det_idx")) % 4 != 0)
    width = F.col("img_w").cast("long") + 2
    lines = d.select(F.col("image_id").cast("string").alias("image_name"), "det_idx", "center_y", side.alias("side"), width.alias("width"), spatial.line_runs(inside).alias("line"))
    runs = spatial.box_runs(F.col("line"), F.col("center_y"), F.col("center_y") + F.col("side"), F.col("width"))
    return spatial.run_geometry(lines.select("image_name", "det_idx", "width", runs.alias("runs")))


# Prompts


def _prompt_rows(spark, sf):
    return captions(spark, sf).select("image_id", expr.clean_caption(F.col("caption")).alias("caption"))


@query
def enhanced_summary(spark, sf):
    rows = prompts.image_facts(detections(spark, sf))
    return rows.select("image_id", expr.enhanced_summary(F.col("summary"), F.col("spatial_description")).alias("summary"))


@query
def spatial_extract(spark, sf):
    return enhanced_summary(spark, sf).select("image_id", expr.spatial_extract(F.col("summary")).alias("layout"))


@query
def combine_prompt(spark, sf):
    return prompts.prompts(_prompt_rows(spark, sf), detections(spark, sf)).select("image_id", "prompt", "word_count", "est_tokens")


@query
def combine_prompt_v1(spark, sf):
    return prompts.prompts(_prompt_rows(spark, sf), detections(spark, sf), vocab.FIRST_VERSION).select("image_id", "prompt", "word_count", "est_tokens")


@query
def combine_prompt_missing(spark, sf):
    """Prompts where some captions, counts or summaries are missing."""
    rows = prompts.with_facts(_prompt_rows(spark, sf), prompts.image_facts(detections(spark, sf)))
    lost = lambda c, n, k: F.when(F.col("image_id") % n != k, F.col(c))
    rows = rows.withColumns({"caption": lost("caption", 11, 5), "counts_text": lost("counts_text", 13, 4), "summary": lost("summary", 7, 2)})
    return prompts.combined(rows).select("image_id", "prompt", "word_count", "est_tokens")


@query
def combine_prompt_stored(spark, sf):
    """The same prompts from captions and facts that are stored by image."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = prompts.co_located(_prompt_rows(spark, sf), detections(spark, sf), f"{shared_folder(spark)}/tables", buckets)
    return prompts.combined(rows).select("image_id", "prompt", "word_count", "est_tokens")


@query
def prompt_checks(spark, sf):
    """Over all images with detections: does every prompt name its counts and keep its layout?"""
    rows = prompts.prompts(_prompt_rows(spark, sf), detections(spark, sf)).where("total > 0")
    has = lambda part: F.contains(F.col("prompt"), part)
    return rows.agg(F.bool_and(has(F.col("counts_text"))).alias("counts_kept"), F.bool_and(has(F.coalesce("spatial_description", F.lit("")))).alias("layout_kept"), F.bool_and(F.col("prompt").startswith(vocab.PRODUCTION.lead)).alias("lead_kept"), F.count(F.lit(1)).alias("n_prompts"))


@query
def metadata_json(spark, sf):
    name = F.concat(F.lit("image_"), F.col("image_id").cast("string"))
    made = pipeline.metadata(F.concat(F.lit("in/"), name, F.lit(".jpg")), expr.output_path("outputs", "images", name, "_generated.png"), F.concat(F.lit("caption of "), name), F.concat(F.lit("Aerial view: "), name))
    return captions(spark, sf).where("NOT is_error").select("image_id", F.to_json(made).alias("metadata"))


# Sets and limits


@query
def limit_images(spark, sf):
    """The scan's own limit: the first five in the deterministic order."""
    path = F.concat(F.lit("image_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".jpg").otherwise(".png"))
    rows = table(spark, sf, "documents").select("doc_id", path.alias("path"), (F.col("doc_id") % 2).alias("ord"))
    return rows.orderBy("ord", "path").limit(5).select("doc_id", "path")


@query
def union_sources(spark, sf):
    jpg = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), F.lit(0).alias("ord"))
    png = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"), F.lit(1).alias("ord"))
    return jpg.unionByName(png)


# Images: every row of `pages` as a file, its bytes as pixels


@query
def scan_images(spark, sf):
    return images.scan(spark, page_images(spark, sf)).select("image_name", "ext", "ord")


@query
def decode_images(spark, sf):
    return images.decode(spark, page_images(spark, sf)).select("image_name", "height", "width", "n_channels", "mode", F.sha2("data", 256).alias("pixels_sha256"))


def _kernel(spark, sf, kernel):
    rows = kernels.apply(images.decode(spark, page_images(spark, sf)), kernel, digest=True)
    return rows.select("image_name", "height", "width", "n_channels", "digest", "error")


@query
def upscale(spark, sf):
    return _kernel(spark, sf, kernels.upscale)


@query
def control_map(spark, sf):
    return _kernel(spark, sf, kernels.control_image)


@query
def preprocess(spark, sf):
    return _kernel(spark, sf, lambda x: kernels.preprocess(x).view(np.uint8))


@query
def pipeline_e2e(spark, sf):
    rows = pipeline.run(spark, page_images(spark, sf), shared_folder(spark))
    return rows.select("image_name", "ok", "error", "prompt", F.col("metadata.output_caption").alias("output_caption"), F.col("metadata.output").alias("output"))


@query
def watch_images(spark, sf):
    """The folder of images as a stream, taken once."""
    own = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    watch.ingest(spark, page_images(spark, sf), f"{own}/files", f"{own}/state").awaitTermination()
    return spark.read.parquet(f"{own}/files").select("image_name", "length")


@query
def benchmark_e2e(spark, sf):
    """Each captioning model on all images, without the times, which differ from run to run."""
    done = pipeline.benchmark(spark, page_images(spark, sf), shared_folder(spark), limit=None)
    return done.seen.groupBy("model_key").agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.col("is_error").cast("long")).alias("n_errors"), F.sum("keyword_count").alias("keywords"), F.round(F.avg("overall"), 9).alias("avg_quality"))


@query
def number_format(spark, sf):
    """Numbers as reports show them; tenths and quarters have no ties that two engines round apart."""
    n = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", expr.fixed(n, 1).alias("one"), expr.fixed(n / 4 + F.lit(0.001), 2).alias("two"), expr.gib(F.col("l_partkey").cast("double") * (1 << 30)).alias("gib"))


@query
def token_trim(spark, sf):
    """Generated ids without the echoed prompt, and the reversal of a size."""
    ids = F.transform(F.split("text", " "), lambda w: F.char_length(w))
    rows = table(spark, sf, "documents").select("doc_id", ids.alias("out"), F.slice(ids, 1, 3).alias("asked"))
    size = expr.reversed_size(F.array("doc_id", F.size("asked").cast("long")))
    return rows.select("doc_id", F.array_join(F.transform(expr.trimmed_tokens(F.col("asked"), F.col("out")), lambda x: x.cast("string")), ",").alias("said"), size[0].alias("first"), size[1].alias("last"))
