"""Kernels against slow loops, the image pipeline with models that fail, sinks read back, and the prompt fixture."""

import json
import math
import time
from collections import Counter
from datetime import datetime
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import terraquill.__main__ as command
from terraquill import config, providers, vocab
from terraquill.functions import expr, kernels
from terraquill.operators import detect, spatial
from terraquill.plans import catalogue, pipeline
from terraquill.sinks import files
from terraquill.sources import fixtures, images
from terraquill.streaming import watch

RNG = np.random.default_rng(3)


def slow_resize(image, height, width):
    def cubic(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def line(values, new):
        old, out = len(values), []
        wide = max(1.0, old / new)
        for i in range(new):
            centre = (i + 0.5) * old / new - 0.5
            w = [cubic((j - centre) / wide) for j in range(old)]
            out.append(sum(a * b for a, b in zip(w, values)) / sum(w))
        return out

    h, w, c = image.shape
    out = np.zeros((height, width, c))
    for ch in range(c):
        tall = np.array([line(image[:, x, ch].tolist(), height) for x in range(w)]).T
        out[..., ch] = [line(row.tolist(), width) for row in tall]
    return np.clip(np.rint(out), 0, 255)


@pytest.mark.parametrize("height, width", [(20, 28), (3, 4), (5, 21)])
def test_resize_matches_a_slow_loop(height, width):
    image = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert np.abs(kernels.resize(image, height, width).astype(int) - slow_resize(image, height, width)).max() <= 1
    assert (kernels.upscale(image) == kernels.resize(image, 20, 28)).all()


def test_control_map_matches_a_slow_loop():
    image = RNG.integers(0, 256, (6, 9, 3), dtype=np.uint8)
    g = [[(19595 * int(p[2]) + 38470 * int(p[1]) + 7471 * int(p[0]) + 32768) >> 16 for p in row] for row in image]

    def ring(x, offset):
        out = [list(r) for r in x]
        for i in range(1, 5):
            for j in range(1, 8):
                around = sum(x[i + a][j + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) - x[i][j]
                out[i][j] = min(255, max(0, 8 * x[i][j] - around + offset))
        return out

    e = ring(ring(g, 0), 255)
    lo, hi = min(map(min, e)), max(map(max, e))
    want = [[int((v - lo) * 255 / (hi - lo)) for v in row] for row in e]
    got = kernels.control_map(image)
    assert got.shape == (6, 9, 3) and np.abs(got[..., 0].astype(int) - want).max() <= 1 and (got[..., 0] == got[..., 2]).all()


def test_preprocess_matches_a_slow_loop():
    image = RNG.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    got = kernels.preprocess(image, 8)
    want = (slow_resize(image[..., ::-1], 8, 8) / 255 - np.array(vocab.IMAGE_MEAN)) / np.array(vocab.IMAGE_STD)
    assert got.shape == (3, 8, 8) and got.dtype == np.float32 and np.abs(got.transpose(1, 2, 0) - want).max() < 0.02


def test_png_round_trip_and_masks():
    for c in (1, 3):
        image = RNG.integers(0, 256, (5, 4, c), dtype=np.uint8)
        assert (kernels.unpng(kernels.png(image)) == image).all()
    mask = np.zeros((4, 5))
    assert kernels.mask_geometry(mask) is None
    mask[1, 2], mask[2, 3], mask[3, 3] = 0.9, 0.6, 0.5
    assert kernels.mask_geometry(mask) == (2, 1, 2)


def write(folder, name, image):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(kernels.png(image))


@pytest.fixture()
def folder(tmp_path):
    y, x = np.mgrid[0:12, 0:16]
    write(tmp_path / "in", "a.png", np.stack([x * 16, y * 20, x + y], axis=2).astype(np.uint8))
    write(tmp_path / "in", "b.png", np.where((x < 5) & (y < 4), 250, 20)[..., None].repeat(3, 2).astype(np.uint8))
    (tmp_path / "in" / "a.jpg").write_bytes(kernels.png((x * 15)[..., None].astype(np.uint8)))  # decoders go by content
    (tmp_path / "in" / "bad.jpg").write_bytes(b"\\xff\\xd8 text")
    (tmp_path / "in" / "no.txt").write_bytes(b"text")
    return tmp_path


def ran(spark, folder, **models):
    rows = pipeline.run(spark, str(folder / "in"), f"file://{folder}/work", pipeline.Models(**models), root=f"file://{folder}/out").collect()
    return {r["origin"].split("/")[-1]: r for r in rows}


def fails(what):
    """A backend whose every method raises."""

    class Broken:
        def __getattr__(self, name):
            def call(*a, **b):
                raise ValueError(what)

            return call

    return Broken


def test_pipeline(spark, folder):
    rows = ran(spark, folder)
    assert {n: r["ok"] for n, r in rows.items()} == {"a.png": True, "b.png": True, "a.jpg": True, "bad.jpg": False}
    assert rows["bad.jpg"]["error"] == "not an image" and rows["bad.jpg"]["metadata"] is None
    b = rows["b.png"]
    big = kernels.upscale(kernels.unpng((folder / "in" / "b.png").read_bytes()))
    read = {n: kernels.unpng((folder / "out" / "images" / f"b_{n}.png").read_bytes()) for n in ("upscaled", "generated", "generated_control")}
    assert (read["upscaled"] == big).all()
    assert (read["generated_control"] == kernels.resize(kernels.control_map(big), 1024, 1024)).all()
    assert (read["generated"] == providers.PixelPainter().paint(b["prompt"], read["generated_control"], controlnet_conditioning_scale=0.6)).all()
    again = spark.read.format("image").load(f"{folder}/out/images/b_upscaled.png").select("image.height", "image.width").first()
    assert tuple(again) == big.shape[:2]
    m = json.loads((folder / "out" / "metadata" / "b.json").read_text())
    assert list(m) == ["source", "output", "output_caption", "generation_prompt", "models"] and m["models"] == vocab.STAGE_MODELS
    assert m["generation_prompt"] == b["prompt"] == b["metadata"]["generation_prompt"] and m["source"].endswith("in/b.png") and m["output"].endswith("images/b_generated.png")
    say = lambda image: providers.PixelTalker()._text(image).removeprefix("The image shows ")
    assert m["output_caption"] == say(read["generated"])
    found = providers.PixelBoxes().detect(big, " . ".join(vocab.DETECT_CLASSES))
    sure = [x for x, s in zip(found["labels"], found["scores"]) if s >= 0.25]
    assert sure and b["prompt"].startswith(f"Satellite photograph of {say(big).lower()} with {Counter(sure)[sure[0]]} {sure[0]}") and "top-left" in b["prompt"]
    assert not (folder / "out" / "images" / "bad_upscaled.png").exists() and not (folder / "out" / "metadata" / "bad.json").exists()


def test_stages_that_fail(spark, folder):
    def no_upscale(image):
        raise ValueError("no room")

    whole = ran(spark, folder)["b.png"]
    rows = ran(spark, folder, upscale=no_upscale)
    assert rows["b.png"]["ok"] and rows["b.png"]["notes"] == ["upscale: no room"]
    assert (kernels.unpng((folder / "out" / "images" / "b_upscaled.png").read_bytes()) == kernels.unpng((folder / "in" / "b.png").read_bytes())).all()

    rows = ran(spark, folder, captioner=lambda: providers.Captioner(fails("mute")))
    assert rows["b.png"]["ok"] and rows["b.png"]["notes"] == ["caption: mute"] and rows["b.png"]["metadata"]["output_caption"] == vocab.FAILED_CAPTION
    assert rows["b.png"]["prompt"].startswith(f"Satellite photograph of {vocab.FAILED_CAPTION.lower()} with ")

    def missing():
        raise OSError("no weights")

    for broken, note in ((missing, []), (fails("blind"), ["detect: blind"])):  # at opening, and at each call
        rows = ran(spark, folder, detector=lambda b=broken: providers.Detector(b))
        assert rows["b.png"]["ok"] and rows["b.png"]["notes"] == note and rows["b.png"]["prompt"].startswith("Aerial view: ")

    rows = ran(spark, folder, localizer=lambda: providers.Localizer(fails("lost")))
    assert rows["b.png"]["ok"] and rows["b.png"]["notes"] == ["locate: lost"] and "Layout" not in rows["b.png"]["prompt"] and "Layout" in whole["prompt"]

    for f in (folder / "out" / "metadata").iterdir():
        f.unlink()
    rows = ran(spark, folder, generator=lambda: providers.Generator(fails("ink")))
    assert not any(r["ok"] for r in rows.values()) and rows["b.png"]["error"] == "generate: ink" and rows["b.png"]["metadata"] is None
    assert not list((folder / "out" / "metadata").iterdir()) and (folder / "out" / "images" / "b_upscaled.png").exists()
    assert files.totals(spark.createDataFrame([(True,), (False,)], "ok boolean")) == "1/2"

    for stage in ("captioner", "localizer", "generator"):
        kind = {"captioner": providers.Captioner, "localizer": providers.Localizer, "generator": providers.Generator}[stage]
        with pytest.raises(Exception, match="no weights"):
            ran(spark, folder, **{stage: lambda k=kind: k(missing)})


def test_one_failed_box_discards_the_image_s_locations():
    class Second(providers.PixelMasks):
        def masks(self, image, box):
            if box[0] > 4:
                raise ValueError("second box")
            return super().masks(image, box)

    one = providers.Localizer(Second)
    one.open()
    row = {"image": np.full((9, 9, 3), 9, np.uint8) * np.arange(9, dtype=np.uint8)[:, None, None], "boxes": [[0, 0, 9, 9], [5, 0, 9, 9]]}
    assert providers.ask(one, [row]) == [({}, "second box")]
    assert [x[0]["locations"] for x in providers.ask(one, [row | {"boxes": [[0, 0, 9, 9], [0, 0, 0, 0]]}])] == [[(0, 4, 6, 36)]]
    ok, bad = {"image": row["image"], "boxes": [[0, 0, 9, 9]]}, row
    assert [why for _, why in providers.ask(one, [ok, bad, ok])] == [None, "second box", None]


def test_captioners():
    image = RNG.integers(0, 256, (6, 6, 3), dtype=np.uint8)
    said = {}
    for key, kind in {**providers.REGISTRY, "scene": providers.Captioner}.items():
        provider = kind()
        provider.open()
        said[key] = provider.predict([{"image": image}])[0]["caption"]
        provider.close()
    text, tensor = providers.PixelTalker()._text(image), providers.PixelTalker()._text(kernels.preprocess(image))
    assert said == {"qwen2vl_2b": text, "internvl2_4b": tensor, "llava_onevision_7b": text, "internvl3_8b": tensor, "scene": text}
    class Slow(providers.PixelTalker):
        def chat(self, *a, **b):
            time.sleep(0.05)
            return "late"

    slow = providers.ChatCaptioner(Slow)
    slow.open()
    began = time.perf_counter()
    (got,) = slow.predict([{"image": image}])
    assert got["caption"] == "late" and 0.05 <= got["inference_time"] < time.perf_counter() - began
    chat = providers.ChatCaptioner(fails("x" * 90))
    chat.open()
    assert chat.predict([{"image": image}])[0]["caption"] == f"[Generation failed: {'x' * 50}]"


def test_benchmark(spark, folder):
    def missing():
        raise OSError("no weights")

    models = {"qwen2vl_2b": providers.DetailCaptioner, "internvl2_4b": lambda: providers.ChatCaptioner(fails("tired")), "llava_onevision_7b": lambda: providers.TemplateCaptioner(missing), "internvl3_8b": lambda: providers.DetailCaptioner(fails("broken"))}
    done = pipeline.benchmark(spark, str(folder / "in"), f"file://{folder}/work", models, limit=3)
    path = done.write(f"file://{folder}/report", files.report_name(datetime(2024, 2, 3, 4, 5, 6)))
    assert path.endswith("benchmark_results_20240203_040506.json")
    report = json.loads((folder / "report" / "benchmark_results_20240203_040506.json").read_text())
    own = report["results"]
    assert set(own) == set(models) and own["llava_onevision_7b"] == {"error": "no weights"}
    names = [r["image_id"].split("/")[-1] for r in done.seen.where("model_key = 'qwen2vl_2b'").orderBy("image_id").collect()]
    assert names == ["a.jpg", "a.png", "bad.jpg"]
    assert own["internvl2_4b"]["captions"] == ["[Generation failed: tired]"] * 2 + ["ERROR: not an image"]
    assert own["internvl3_8b"]["captions"] == ["ERROR: broken"] * 2 + ["ERROR: not an image"] and own["internvl3_8b"]["inference_times"] == [0.0] * 3
    assert own["qwen2vl_2b"]["model_name"] == "Qwen/Qwen2-VL-2B-Instruct" and own["qwen2vl_2b"]["quality_scores"][2] == {"overall": 0.0}
    assert [r["model"] for r in report["summary"]] == ["qwen2vl_2b", "internvl2_4b", "internvl3_8b"]
    lines = done.console()
    assert lines[0] == "llava_onevision_7b: FAILED - no weights" and lines[-1].startswith("best model: qwen2vl_2b (")
    best = done.ranking.orderBy("rank").first()
    assert any(line == f"1. qwen2vl_2b (combined score {best['combined_score']:.3f})" for line in lines)


def test_scan_limit_guard_and_order(spark, folder):
    rows = images.scan(spark, str(folder / "in")).orderBy("ord", "path").collect()
    assert [(r["path"].split("/")[-1], r["image_name"], r["ext"], r["ord"]) for r in rows] == [("a.jpg", "a", "jpg", 0), ("bad.jpg", "bad", "jpg", 0), ("a.png", "a", "png", 1), ("b.png", "b", "png", 1)]
    assert [r["path"].split("/")[-1] for r in images.scan(spark, str(folder / "in"), 3).collect()] == ["a.jpg", "bad.jpg", "a.png"]
    assert images.scan(spark, str(folder / "in"), 0).count() == 4
    decoded = {r["origin"].split("/")[-1]: r for r in images.decode(spark, str(folder / "in")).collect()}
    assert (decoded["bad.jpg"]["height"], decoded["bad.jpg"]["width"], decoded["bad.jpg"]["n_channels"], decoded["bad.jpg"]["mode"]) == (-1, -1, -1, -1)
    assert (np.frombuffer(bytes(decoded["b.png"]["data"]), np.uint8).reshape(12, 16, 3) == kernels.unpng((folder / "in" / "b.png").read_bytes())).all()
    assert images.decode(spark, str(folder / "in"), drop_invalid=True).count() == 3
    rows = pipeline.run(spark, str(folder / "in"), f"file://{folder}/work", limit=1).collect()
    assert [r["origin"].split("/")[-1] for r in rows] == ["a.jpg"]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert pipeline.run(spark, str(tmp_path / "in"), f"file://{tmp_path}/work").count() == 0
    done = pipeline.benchmark(spark, str(tmp_path / "in"), f"file://{tmp_path}/work")
    assert done.seen.count() == 0 and done.console() == []


def test_stream_takes_each_file_once(spark, folder):
    out, state = f"file://{folder}/seen", f"file://{folder}/state"
    watch.ingest(spark, str(folder / "in"), out, state).awaitTermination()
    write(folder / "in", "late.png", np.zeros((2, 2, 3), np.uint8))
    watch.ingest(spark, str(folder / "in"), out, state).awaitTermination()
    assert sorted(r["image_name"] for r in spark.read.parquet(out).collect()) == ["a", "a", "b", "bad", "late"]


def test_captions_from_a_table(spark):
    shown = spark.createDataFrame([("a",), ("b",)], "image_name string")
    rows = providers.from_table(shown, spark.createDataFrame([("a", "a view"), ("a", "a view")], "image_name string, caption string")).orderBy("image_name").collect()
    assert [(r["caption"], r["error"]) for r in rows] == [("a view", None), (None, "no caption")]


def test_pipeline_with_captions_from_a_table(spark, folder):
    known = spark.createDataFrame([("b", "The image shows Two barns."), ("zzz", "none")], "image_name string, caption string")
    rows = {r["origin"].split("/")[-1]: r for r in pipeline.run(spark, str(folder / "in"), f"file://{folder}/work", captions=known).collect()}
    assert len(rows) == 4 and rows["b.png"]["prompt"].startswith("Satellite photograph of two barns. with ")
    assert vocab.FAILED_CAPTION.lower() in rows["a.png"]["prompt"].lower() and not rows["bad.jpg"]["ok"]


def test_config(monkeypatch):
    for name in ("INPUT_DIR", "OUTPUT_DIR", "HF_CACHE_DIR"):
        monkeypatch.delenv(name, raising=False)
    assert config.Config() == config.Config("datasets/rsicd_images", "outputs/pipeline_results", "outputs/vlm_benchmark", "./hf_cache")
    monkeypatch.setenv("INPUT_DIR", "/x")
    assert config.Config().input_dir == "/x"


def test_main(spark, folder, monkeypatch, capsys):
    monkeypatch.setenv("INPUT_DIR", str(folder / "in"))
    monkeypatch.setenv("OUTPUT_DIR", f"file://{folder}/main")
    monkeypatch.setattr(command, "Config", lambda: config.Config(benchmark_dir=f"file://{folder}/bench"))
    command.main("pipeline")
    assert "1/1 images" in capsys.readouterr().out and (folder / "main" / "metadata" / "a.json").exists()
    command.main("benchmark")
    said = capsys.readouterr().out.splitlines()
    assert any(x.startswith("best model: ") for x in said) and said[-1].startswith(f"file://{folder}/bench/benchmark_results_") and len(list((folder / "bench").glob("*.json"))) == 1
    with pytest.raises(SystemExit):
        command.main("")


def test_prompt_of_the_dense_and_the_plain_scene(spark):
    counts = [("building", 47), ("house", 23), ("apartment building", 15), ("vehicle", 8), ("tree", 34), ("road", 12)]
    text = ", ".join(f"{n} {label}" for label, n in counts)
    layout = "buildings concentrated in top-left and center regions, vehicles in bottom-left and center-right"
    rows = spark.createDataFrame([("A Dense residential area.", text, 139, f"{text}. Spatial layout: {layout}"), ("A simple aerial view of farmland.", "", 0, "")], "caption string, counts string, total long, summary string")
    for template, mark in ((vocab.FIRST_VERSION, "Spatial"), (vocab.PRODUCTION, "Layout")):
        made = [r[0] for r in rows.select(expr.combine_prompt(*map(F.col, ("caption", "counts", "total", "summary")), template)).collect()]
        assert all(f"{n} {label}" in made[0] for label, n in counts) and mark in made[0] and layout in made[0]
        assert made[0] == f"{template.lead}a dense residential area.{template.counts}{text}{template.layout}{layout}{template.suffix}"
        assert made[1] == "Aerial view: A simple aerial view of farmland."
        assert math.floor(len(made[0].split()) * 1.3) <= 512


def test_detections_against_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(i, j, str(rng.choice(["car", "tree", "road"])), float(rng.random()), int(rng.integers(0, 90)), int(rng.integers(0, 60)), int(rng.integers(0, 3)) * 900, 90, 60) for i in range(20) for j in range(int(rng.integers(0, 9)))]
    det = spark.createDataFrame(rows, "image_id long, det_idx long, label string, score double, center_x int, center_y int, area int, img_w int, img_h int")
    got = {r["image_id"]: r for r in detect.texts(detect.confident(det)).collect()}
    places = {r["image_id"]: r["spatial_description"] for r in spatial.descriptions(spatial.located(detect.confident(det))).collect()}
    for i in range(20):
        own = [r for r in rows if r[0] == i and r[3] >= 0.25]
        counts = Counter(r[2] for r in own)  # insertion order is that of appearance
        assert (got[i]["total"], got[i]["counts_text"], got[i]["summary"]) == (len(own), ", ".join(f"{n} {c}" for c, n in counts.items()), ", ".join(f"{n} {c}" for c, n in counts.most_common(3))) if own else i not in got
        grid: dict = {}
        for r in own:
            if r[6] > 0:
                grid.setdefault(vocab.POSITIONS[min(2, int(r[5] / 20)) * 3 + min(2, int(r[4] / 30))], Counter())[r[2]] += 1
        parts = [(f"{c} in {p}" if n == 1 else f"{n} {c}s in {p}") if len(x) == 1 and (c := next(iter(x))) and (n := x[c]) else ", ".join(f"{n} {c}{'s' * (n > 1)}" for c, n in x.items()) + f" in {p}" for p, x in list(grid.items())[:5]]
        assert places.get(i) == ("; ".join(parts) if parts else None)


def test_images_of_pages(spark, tmp_path):
    """Bytes become pixels of the named layout, kernels' queries say what the kernels give, odd pages are no images."""
    rows = [(0, "abcde"), (1, "abcdefgh"), (2, ""), (3, "never"), (4, None), (5, "ü" * 40), (None, "x"), (6, "z")]
    spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["image_name"]: r for r in catalogue.decode_images(spark, str(tmp_path)).collect()}
    assert sorted(got) == [f"page_{i}" for i in range(7)]
    assert [got[f"page_{i}"]["height"] for i in range(7)] == [2, 2, -1, -1, -1, 5, 1]
    assert (got["page_0"]["width"], got["page_0"]["n_channels"], got["page_1"]["width"], got["page_1"]["n_channels"]) == (3, 1, 2, 3)
    assert got["page_1"]["pixels_sha256"] == sha256(b"abcdefgh" + b"\0" * 4).hexdigest()
    big = {r["image_name"]: r for r in catalogue.upscale(spark, str(tmp_path)).collect()}
    for i, html in rows:
        if i is not None and (image := fixtures.page_pixels(i, html)) is not None:
            want = kernels.upscale(image)
            assert big[f"page_{i}"]["digest"] == sha256(want.tobytes()).hexdigest() and big[f"page_{i}"]["error"] is None
    assert big["page_3"]["error"] == "not an image"
    assert fixtures.page_images(spark, str(tmp_path)) == fixtures.page_images(spark, str(tmp_path))


def test_models_get_several_images_at_once(spark, folder):
    """As many as TOGETHER at a call; where one image of a call fails, the others' replies stay."""
    for i in range(9):
        write(folder / "in", f"n{i}.png", np.full((4, 5, 3), 20 + i, np.uint8))

    class Counting(providers.Captioner):
        def predict(self, rows):
            if any((r["image"] == 25).all() for r in rows):
                raise ValueError("25")
            return [{"caption": f"one of {len(rows)}"} for _ in rows]

    decoded = images.decode(spark, str(folder / "in")).where("image_name LIKE 'n%'").coalesce(1)
    rows = {r["image_name"]: r for r in pipeline.annotate(decoded, pipeline.Models(captioner=Counting)).collect()}
    assert len(rows) == 9 and rows["n5"]["caption"] is None and rows["n5"]["notes"] == ["caption: 25"] and rows["n5"]["error"] is None
    assert all(r["caption"].startswith("one of ") for n, r in rows.items() if n != "n5")
    rows = pipeline.annotate(decoded.where("image_name <> 'n5'"), pipeline.Models(captioner=Counting)).collect()
    assert {r["caption"] for r in rows} == {f"one of {pipeline.TOGETHER}"}

    class Short(providers.Captioner):
        def predict(self, rows):
            return super().predict(rows)[1:]

    assert {r["notes"][0] for r in pipeline.annotate(decoded, pipeline.Models(captioner=Short)).collect()} == {"caption: 0 replies to 1 rows"}

    class Odd(providers.PixelBoxes):
        def detect(self, image, classes):
            return super().detect(image, classes) | ({"boxes": [[0.0] * 4], "scores": [None], "labels": ["car"]} if (image == 22).all() else {})

    rows = {r["image_name"]: r["error"] for r in pipeline.annotate(decoded, pipeline.Models(detector=lambda: providers.Detector(Odd))).collect()}
    assert [n for n, why in rows.items() if why] == ["n2"]


def test_weights_come_from_the_cache_folder(spark, folder):
    (folder / "cache").mkdir()
    (folder / "cache" / "weights.txt").write_text("The image shows a stored answer.")

    class Stored(providers.PixelTalker):
        def __init__(self, cache_dir):
            with open(f"{cache_dir}/weights.txt") as f:
                self.answer = f.read()

        def _text(self, x):
            return self.answer

    cached = providers.with_cache(providers.Captioner, config.Config(cache_dir=str(folder / "cache")).cache_dir, Stored)
    rows = ran(spark, folder, captioner=cached)
    assert rows["b.png"]["metadata"]["output_caption"] == "a stored answer."
    with pytest.raises(Exception, match="weights.txt"):
        ran(spark, folder, captioner=providers.with_cache(providers.Captioner, str(folder / "none"), Stored))


def test_control_image_resizes_one_channel(monkeypatch):
    """Three equal channels cost one; the result is the one of all three."""
    image = RNG.integers(0, 256, (7, 11, 3), dtype=np.uint8)
    want, resize, asked = kernels.resize(kernels.control_map(image), 32, 32), kernels.resize, []
    monkeypatch.setattr(kernels, "resize", lambda x, h, w: asked.append(x.shape[2]) or resize(x, h, w))
    assert (kernels.control_image(image, 32) == want).all() and asked == [1]


def test_preprocess_of_gray_resizes_one_channel(monkeypatch):
    gray = RNG.integers(0, 256, (1, 4, 1), dtype=np.uint8)
    want, resize, asked = kernels.preprocess(gray.repeat(3, 2), 8), kernels.resize, []
    monkeypatch.setattr(kernels, "resize", lambda x, h, w: asked.append(x.shape[2]) or resize(x, h, w))
    got = kernels.preprocess(gray, 8)
    assert (got == want).all() and got.dtype == np.float32 and asked == [1]
    assert got.view(np.uint8).shape == (3, 8, 32)


def test_digests_are_made_in_the_task(spark, folder):
    """Digests instead of pixels come out of the tasks, for failed rows as well."""
    decoded = images.decode(spark, str(folder / "in"))
    whole = {r["origin"]: r for r in kernels.apply(decoded, kernels.control_image).collect()}
    rows = kernels.apply(decoded, kernels.control_image, digest=True)
    assert "data" not in rows.columns and rows.count() == 4
    for r in rows.collect():
        assert r["digest"] == sha256(bytes(whole[r["origin"]]["data"])).hexdigest() and r["error"] == whole[r["origin"]]["error"]


def test_what_is_kept_for_control_images_is_small(spark, folder):
    """Between the passes an image takes about its own bytes, however large its control image; that comes out as before."""
    decoded = images.decode(spark, str(folder / "in"))
    rows = {r["origin"].split("/")[-1]: r for r in pipeline.annotate(decoded).collect()}
    assert rows["b.png"]["kept"] == "image" and len(rows["b.png"]["control"]) < 1000 and rows["bad.jpg"]["kept"] is None
    image = kernels.unpng((folder / "in" / "b.png").read_bytes())
    for upscale in (lambda x: kernels.resize(x, 50, 70), lambda x: kernels.resize(x, 1024, 1024), lambda x: kernels.resize(x, 1100, 1030)):
        row = next(r for r in pipeline.annotate(decoded, pipeline.Models(upscale=upscale)).collect() if r["origin"].endswith("b.png"))
        big = upscale(image)
        assert row["kept"] == ("luma" if big.shape[0] < 1000 else "control")
        assert (pipeline._control(row["kept"], bytes(row["control"])) == kernels.resize(kernels.control_map(big), 1024, 1024)).all()
        assert len(row["control"]) < 1.1 * min(big[..., 0].size, 1 << 20)


def test_benchmark_lists_and_decodes_images_once(spark, folder, monkeypatch):
    """The models' passes read stored rows, which are gone when they are done; all images need no scan for their order."""
    scan, given, calls = images.scan, [], []
    monkeypatch.setattr(images, "scan", lambda spark, path, limit=None: calls.append(limit) or scan(spark, path, limit))
    benchmark = providers.benchmark
    monkeypatch.setattr(providers, "benchmark", lambda decoded, models: given.append(decoded.inputFiles()) or benchmark(decoded, models))
    models = {"qwen2vl_2b": providers.DetailCaptioner, "internvl2_4b": providers.ChatCaptioner}
    counts = [pipeline.benchmark(spark, str(folder / "in"), f"file://{folder}/work", models, limit=n).seen.groupBy("model_key").count().collect() for n in (None, 3)]
    assert [{tuple(r) for r in c} for c in counts] == [{(m, n) for m in models} for n in (4, 3)]
    assert calls == [3] and all(f.endswith(".parquet") for files in given for f in files) and not list(folder.glob("work/*/decoded"))
