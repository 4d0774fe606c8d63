"""From an image directory to generated images and their metadata, and the benchmark of captioning models.

Two passes see pixels. The first decodes an image once, enlarges it, and asks captioner, detector and localizer; the second
makes the control image, generates from it and the prompt, and describes the result. Between them only names, texts, boxes
and the least pixels that the control image follows from (compressed) move: the image itself where plain resampling enlarged
it, else the enlarged image's luma, and never more than the control image, of one channel. The first pass is kept as Parquet,
so no branch computes it again.

Error rules, each with its reason in a column instead of a printed trace: an image that can't be decoded fails; one that
can't be enlarged goes on as it is; no caption gives a fixed one; a detector that can't be opened or fails gives no
detections; a localizer that fails gives no location of that image; a generator that fails gives no metadata, and what was
written before stays. Captioner, localizer and generator that can't be opened end the job.

Images are told apart by their path. Their files are named after the stem, so of two images with the same stem in one
folder the files of one stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill import providers, vocab
from terraquill.functions import expr, kernels
from terraquill.operators import evaluate, prompts
from terraquill.operators.shared import discard
from terraquill.providers import Provider
from terraquill.sinks import files
from terraquill.sources import images


@dataclass(frozen=True)
class Models:
    """What makes the models of a run; a provider that is given a cache folder hands it to its backend."""

    captioner: Callable[[], Provider] = providers.Captioner
    detector: Callable[[], Provider] = providers.Detector
    localizer: Callable[[], Provider] = providers.Localizer
    generator: Callable[[], Provider] = providers.Generator
    upscale: Callable[[np.ndarray], np.ndarray] = kernels.upscale


def metadata(source: Column, output: Column, caption: Column, prompt: Column) -> Column:
    models = F.struct(*[F.lit(v).alias(k) for k, v in vocab.STAGE_MODELS.items()])
    return F.struct(source.alias("source"), output.alias("output"), caption.alias("output_caption"), prompt.alias("generation_prompt"), models.alias("models"))


#: Images that a model gets at once; so many are held, enlarged, in a task.
TOGETHER = 8


def _captions(captioner: Provider, pictures: list[np.ndarray]) -> list[tuple[str | None, str | None]]:
    """Captions, null only where the captioner failed, and why."""
    return [(got.get("caption") or "", None) if why is None else (None, why) for got, why in providers.ask(captioner, [{"image": x} for x in pictures])]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    for pdf in batches:
        for at in range(0, len(pdf), TOGETHER):
            yield list(pdf.iloc[at : at + TOGETHER].itertuples(index=False))


def _kept(image: np.ndarray, big: np.ndarray, plain: bool) -> tuple[str, bytes]:
    """What the control image of `big` follows from, and how. plain: kernels.upscale makes `big` of the image."""
    if (image.size if plain else big[..., 0].size) >= vocab.OUTPUT_SIZE**2:
        return "control", kernels.png(kernels.control_image(big)[..., :1])
    return ("image", kernels.png(image)) if plain else ("luma", kernels.png(kernels.gray(big)[..., None]))


def _control(kept: str, data: bytes) -> np.ndarray:
    """The control image of what `_kept` gave."""
    pixels = kernels.unpng(data)
    if kept == "control":
        return np.repeat(pixels, 3, axis=2)
    return kernels.control_image(kernels.upscale(pixels) if kept == "image" else pixels)


_FOUND = "origin string, image_name string, img_h int, img_w int, caption string, det array<struct<det_idx:int,label:string,score:double,center_x:int,center_y:int,area:long>>, kept string, control binary, error string, notes array<string>"


def annotate(decoded: DataFrame, models: Models = Models(), root: str | None = None) -> DataFrame:
    """A row for each decoded row: size after enlarging, caption (null if it failed), confident detections with what the
    localizer found of them, what the control image follows from as PNG, a reason where the image fails, and notes on what
    failed else."""

    def enlarged(r, notes: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """The image, enlarged, and whether that is plain resampling."""
        image = kernels.array_of(r.height, r.width, r.n_channels, r.data)
        plain = models.upscale is kernels.upscale
        try:
            big = models.upscale(image)
        except Exception as e:  # noqa: BLE001
            big, plain = image, False
            notes.append(f"upscale: {e}")
        if root:
            files.put(f"{root}/images/{r.image_name}_upscaled.png", kernels.png(big))
        return image, big, plain

    def seen(rows: list, captioner: Provider, detector: Provider, localizer: Provider) -> list[tuple]:
        notes, big, made, sure, lost = [[] for _ in rows], {}, {}, {}, {}
        for i, r in enumerate(rows):
            try:
                if r.height < 1:
                    raise ValueError("not an image")
                made[i] = enlarged(r, notes[i])
                big[i] = made[i][1]
            except Exception as e:  # noqa: BLE001  a bad image must not end the job
                lost[i] = str(e) or type(e).__name__
        captions = dict(zip(big, _captions(captioner, list(big.values()))))
        found = dict(zip(big, providers.ask(detector, [{"image": x} for x in big.values()])))
        for i, (got, _) in found.items():
            try:
                sure[i] = [x for x in zip(got.get("boxes", []), got.get("scores", []), got.get("labels", [])) if x[1] >= vocab.SCORE_LEAST]
            except Exception as e:  # noqa: BLE001
                lost[i] = str(e) or type(e).__name__
        located = dict(zip(sure, providers.ask(localizer, [{"image": big[i], "boxes": [b for b, *_ in sure[i]]} for i in sure])))
        out = []
        for i, r in enumerate(rows):
            try:
                if i in lost:
                    raise ValueError(lost[i])
                for what, (_, why) in (("caption", captions[i]), ("detect", found[i]), ("locate", located[i])):
                    notes[i] += [f"{what}: {why}"] * (why is not None)
                where = {k: g for k, *g in located[i][0].get("locations", [])}
                det = [(k, label, float(score), *where.get(k, (None, None, None))) for k, (_, score, label) in enumerate(sure[i])]
                names = ("det_idx", "label", "score", "center_x", "center_y", "area")
                out.append((r.origin, r.image_name, *big[i].shape[:2], captions[i][0], [dict(zip(names, d)) for d in det], *_kept(*made[i]), None, notes[i]))
            except Exception as e:  # noqa: BLE001
                out.append((r.origin, r.image_name, None, None, None, [], None, None, str(e) or type(e).__name__, notes[i]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = [m() for m in (models.captioner, models.detector, models.localizer)]
        for m in opened:
            m.open()
        columns = [x.split(" ")[0] for x in _FOUND.split(", ")]
        try:
            for rows in _chunks(batches):
                yield pd.DataFrame(seen(rows, *opened), columns=columns).astype({"img_h": "Int32", "img_w": "Int32"})
        finally:
            for m in opened:
                m.close()

    return decoded.select("origin", "image_name", "height", "width", "n_channels", "data").mapInPandas(run, _FOUND)


def generate(made: DataFrame, models: Models = Models(), root: str | None = None, out: str = "outputs") -> DataFrame:
    """(origin, ok, output, output_caption, error) of (origin, image_name, prompt, kept, control)."""
    base = root or out

    def painted(rows: list, generator: Provider, captioner: Provider) -> list[tuple]:
        asked, lost, kept = {}, {}, {}
        for i, r in enumerate(rows):
            try:
                control = _control(r.kept, bytes(r.control))
                if root:
                    files.put(f"{base}/images/{r.image_name}_generated_control.png", kernels.png(control))
                asked[i] = {"prompt": r.prompt, "control": control}
            except Exception as e:  # noqa: BLE001
                lost[i] = str(e) or type(e).__name__
        for i, (got, why) in zip(asked, providers.ask(generator, list(asked.values()))):
            try:
                if why is not None:
                    raise ValueError(f"generate: {why}")
                if root:
                    files.put(f"{base}/images/{rows[i].image_name}_generated.png", kernels.png(got["image"]))
                kept[i] = got["image"]
            except Exception as e:  # noqa: BLE001
                lost[i] = str(e) or type(e).__name__
        said = dict(zip(kept, _captions(captioner, list(kept.values()))))
        return [(r.origin, False, None, None, lost[i]) if i in lost else (r.origin, True, f"{base}/images/{r.image_name}_generated.png", said[i][0], None) for i, r in enumerate(rows)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator, captioner = models.generator(), models.captioner()
        generator.open(), captioner.open()
        try:
            for rows in _chunks(batches):
                yield pd.DataFrame(painted(rows, generator, captioner), columns=["origin", "ok", "output", "output_caption", "error"])
        finally:
            generator.close(), captioner.close()

    return made.select("origin", "image_name", "prompt", "kept", "control").mapInPandas(run, "origin string, ok boolean, output string, output_caption string, error string")


def run(spark: SparkSession, path: str, work: str, models: Models = Models(), root: str | None = None, limit: int | None = None, captions: DataFrame | None = None) -> DataFrame:
    """(origin, image_name, ok, error, notes, prompt, metadata): every file a row; failed ones have ok false, no metadata.

    work: a folder that all executors share, for the two passes' rows. root: where the images' files go; none are written
    without it. limit: as many files as that, in the scan's order. captions: (image_name, caption) made before, in place of
    the captioner's of the input images; an image without one counts as one whose caption failed.
    """
    work = f"{work.rstrip('/')}/run-{uuid.uuid4().hex}"
    decoded = images.decode(spark, path)
    if limit:
        decoded = decoded.join(F.broadcast(images.scan(spark, path, limit).select(F.regexp_replace("path", "^file:/+", "file:///").alias("origin"))), "origin", "left_semi")
    annotate(decoded, models, root and root.rstrip("/")).write.parquet(f"{work}/found")
    found = spark.read.schema(_FOUND).parquet(f"{work}/found")
    good = found.where("error IS NULL")
    if captions is not None:
        good = providers.from_table(good.drop("caption"), captions)
    said = lambda c: F.when(F.col(c).isNull(), vocab.FAILED_CAPTION).otherwise(expr.clean_caption(F.col(c)))
    spoken = good.select(F.col("origin").alias("image_id"), said("caption").alias("caption"))
    det = good.select(F.col("origin").alias("image_id"), "img_w", "img_h", F.explode("det").alias("d")).select("image_id", "img_w", "img_h", "d.*")
    prompted = prompts.prompts(spoken, det).select(F.col("image_id").alias("origin"), "prompt")
    generate(good.select("origin", "image_name", "kept", "control").join(prompted, "origin"), models, root and root.rstrip("/")).write.parquet(f"{work}/made")
    made = spark.read.parquet(f"{work}/made").withColumnRenamed("error", "why").join(prompted, "origin")
    rows = found.select("origin", "image_name", "error", "notes").join(made, "origin", "left")
    full = F.when(F.coalesce("ok", F.lit(False)), metadata(F.col("origin"), F.col("output"), said("output_caption"), F.col("prompt")))
    done = rows.select("origin", "image_name", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("error", "why").alias("error"), "notes", "prompt", full.alias("metadata"))
    if root:
        files.write_metadata(done.where("ok"), f"{root.rstrip('/')}/metadata")
    return done


@dataclass(frozen=True)
class Benchmark:
    seen: DataFrame
    failed: DataFrame
    summary: DataFrame
    ranking: DataFrame

    def write(self, folder: str, name: str | None = None) -> str:
        return files.write_report(files.benchmark_results(self.seen, self.failed), self.summary, folder, name)

    def console(self) -> list[str]:
        return files.console(self.ranking, self.failed)


def benchmark(spark: SparkSession, path: str, work: str, models: dict[str, Callable[[], Provider]] | None = None, limit: int | None = 5) -> Benchmark:
    """Each model of the registry on the first `limit` images. A model that can't be opened keeps no observation.

    The images are listed and decoded once, kept as Parquet for the models' passes, and deleted after them: the driver holds
    one list of files, whatever the number of models. All images need no order, so they are then neither scanned nor joined.
    """
    models = providers.REGISTRY if models is None else models
    work = f"{work.rstrip('/')}/benchmark-{uuid.uuid4().hex}"
    decoded = images.decode(spark, path)
    if limit:
        decoded = decoded.join(F.broadcast(images.scan(spark, path, limit).select(F.regexp_replace("path", "^file:/+", "file:///").alias("origin"))), "origin", "left_semi")
    decoded.write.option("compression", "zstd").parquet(f"{work}/decoded")
    providers.benchmark(spark.read.schema(decoded.schema).parquet(f"{work}/decoded"), models).write.parquet(f"{work}/replies")
    discard(spark, f"{work}/decoded")
    replies = spark.read.parquet(f"{work}/replies")
    failed = replies.where("model_error IS NOT NULL").groupBy("model_key").agg(F.min("model_error").alias("error"))
    named = evaluate.models_table(spark).select("model_ord", F.col("model").alias("model_key"))
    kept = replies.join(F.broadcast(failed.select("model_key")), "model_key", "left_anti").join(F.broadcast(named), "model_key")
    seen = evaluate.observations(kept.select("model_key", "model_ord", F.col("origin").alias("image_id"), "caption", "inference_time", F.col("error").isNotNull().alias("is_error")))
    summary = evaluate.summary(seen)
    return Benchmark(seen, failed, summary, evaluate.ranking(summary))
