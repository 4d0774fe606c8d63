"""Models as providers: opened once for each task, fed rows with pixels, closed at its end.

A provider holds what belongs to a model's use (question, options, treatment of the reply, error rules); the model itself is
a backend, made in open(). No weights come with this: the backends here compute plain answers from the pixels alone, so
every path runs and can be tested. A backend for weights has the same methods.
"""

from __future__ import annotations

import gc
import time
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill import vocab
from terraquill.functions import expr, kernels


class Provider(Protocol):
    """open() may raise; what predict() raises becomes the rows' error."""

    def open(self) -> None: ...

    def predict(self, rows: list[dict]) -> list[dict]: ...

    def close(self) -> None: ...


# Backends


class PixelTalker:
    """Replies that depend on the pixels alone; as models do, it repeats the question's tokens before its own."""

    def _text(self, x: np.ndarray) -> str:
        seed = zlib.crc32(np.ascontiguousarray(x).tobytes())
        pick = lambda terms, shift: terms[(seed >> shift) % len(terms)]
        return f"The image shows {seed % 9} {pick(vocab.AERIAL_KEYWORDS, 3)} near the {pick(vocab.SPATIAL_TERMS, 9)}."

    def generate(self, image: np.ndarray, question: str, **options) -> tuple[list[int], list[int]]:
        """Token ids of the question, and of the question and the reply."""
        asked = list(question.encode())
        return asked, asked + list(self._text(image).encode())[: 8 * options["max_new_tokens"]]

    def decode(self, ids: list[int]) -> str:
        return bytes(ids).decode(errors="replace")

    def chat(self, tensor: np.ndarray, question: str, **options) -> str:
        return self._text(tensor)


class PixelBoxes:
    """A box for each ninth of the image that is brighter than the whole, as fractions of width and height."""

    def detect(self, image: np.ndarray, classes: str) -> dict:
        names, bright = classes.split(" . "), image.mean(axis=2)
        out: dict = {"boxes": [], "scores": [], "labels": []}
        for row in range(3):
            for column in range(3):
                part = bright[row * bright.shape[0] // 3 : (row + 1) * bright.shape[0] // 3, column * bright.shape[1] // 3 : (column + 1) * bright.shape[1] // 3]
                if part.size and (more := float(part.mean() - bright.mean())) > 0:
                    out["boxes"].append([column / 3, row / 3, (column + 1) / 3, (row + 1) / 3])
                    out["scores"].append(min(1.0, more / 64))
                    out["labels"].append(names[int(part.mean()) % len(names)])
        return out


class PixelMasks:
    """Three masks a box: its pixels brighter than the image's mean, all of it, and none."""

    def masks(self, image: np.ndarray, box: list[float]) -> np.ndarray:
        bright, inside = image.mean(axis=2), np.zeros(image.shape[:2])
        x0, y0, x1, y1 = (int(v) for v in box)
        inside[y0:y1, x0:x1] = 1.0
        return np.stack([inside * (bright > bright.mean()), inside, np.zeros_like(inside)])


class PixelPainter:
    """The control image, coloured by the prompt."""

    def paint(self, prompt: str, control: np.ndarray, **options) -> np.ndarray:
        seed = zlib.crc32(prompt.encode())
        colour = np.array([seed & 255, seed >> 8 & 255, seed >> 16 & 255], np.float64)
        strength = options["controlnet_conditioning_scale"]
        painted = np.clip(strength * np.arange(256)[:, None] + (1 - strength) * colour, 0, 255).astype(np.uint8)  # of each value, each channel
        return np.stack([painted[:, i].take(control[..., i]) for i in range(3)], axis=2)


# Providers


def made(backend: Callable, cache_dir: str | None) -> object:
    """A backend; one that keeps weights gets the folder for them."""
    return backend() if cache_dir is None else backend(cache_dir=cache_dir)


def with_cache(make: Callable[..., Provider], cache_dir: str, stores: Callable) -> Callable[[], Provider]:
    """What makes the provider with a backend that keeps its weights in the folder."""
    return lambda: make(stores, cache_dir)


class Captioner:
    """A caption from an image, and the seconds that the model took to reply; the echoed question is cut off."""

    question, options = vocab.SCENE_QUESTION, vocab.SCENE_OPTIONS

    def __init__(self, backend: Callable[..., object] = PixelTalker, cache_dir: str | None = None):
        self.backend, self.cache_dir, self.model, self.seconds = backend, cache_dir, None, 0.0

    def open(self) -> None:
        self.model = made(self.backend, self.cache_dir)

    def timed(self, ask: Callable, *args) -> object:
        """What the model replies. Only its own time counts, not what is done to the image before."""
        began = time.perf_counter()
        try:
            return ask(*args, **self.options)
        finally:
            self.seconds = time.perf_counter() - began

    def reply(self, image: np.ndarray) -> str:
        asked, said = self.timed(self.model.generate, image, self.question)
        return self.model.decode(said[len(asked) :])

    def predict(self, rows: list[dict]) -> list[dict]:
        return [{"caption": self.reply(r["image"]), "inference_time": self.seconds} for r in rows]

    def close(self) -> None:
        self.model = None
        gc.collect()


class DetailCaptioner(Captioner):
    question, options = vocab.DETAIL_QUESTION, vocab.DETAIL_OPTIONS


class ChatCaptioner(Captioner):
    """Asks with a preprocessed tensor. What goes wrong while the model replies becomes the caption, and counts as one."""

    question, options = "<image>\n" + vocab.DETAIL_QUESTION, vocab.CHAT_OPTIONS

    def reply(self, image: np.ndarray) -> str:
        tensor = kernels.preprocess(image)
        try:
            return self.timed(self.model.chat, tensor, self.question)
        except Exception as e:  # noqa: BLE001
            return f"[Generation failed: {str(e)[:50]}]"


class TemplateCaptioner(Captioner):
    """Reads the reply from the whole conversation, after its last `assistant`."""

    question, options = vocab.DETAIL_QUESTION, vocab.CHAT_OPTIONS

    def reply(self, image: np.ndarray) -> str:
        _, said = self.timed(self.model.generate, image, f"user {self.question} assistant ")
        whole = self.model.decode(said)
        return whole.split("assistant")[-1].strip() if "assistant" in whole.lower() else whole


class Detector:
    """Boxes in pixels, scores and labels. A backend that can't be made leaves every image without detections."""

    def __init__(self, backend: Callable[..., object] = PixelBoxes, cache_dir: str | None = None):
        self.backend, self.cache_dir, self.model = backend, cache_dir, None

    def open(self) -> None:
        try:
            self.model = made(self.backend, self.cache_dir)
        except Exception:  # noqa: BLE001  the detector alone may be missing
            self.model = None

    def predict(self, rows: list[dict]) -> list[dict]:
        none: dict = {"boxes": [], "scores": [], "labels": []}
        return [self._scaled(self.model.detect(r["image"], " . ".join(vocab.DETECT_CLASSES)), r["image"].shape[1::-1]) if self.model else none for r in rows]

    @staticmethod
    def _scaled(found: dict, size: tuple[int, int]) -> dict:
        """Boxes from fractions to pixels. size is (width, height), for x and y of both corners."""
        return found | {"boxes": [[v * n for v, n in zip(b, size * 2)] for b in found["boxes"]]}

    def close(self) -> None:
        self.model = None
        gc.collect()


class Localizer:
    """(index, centre, area) of each box whose first mask isn't empty; one call of the model for each box."""

    def __init__(self, backend: Callable[..., object] = PixelMasks, cache_dir: str | None = None):
        self.backend, self.cache_dir, self.model = backend, cache_dir, None

    def open(self) -> None:
        self.model = made(self.backend, self.cache_dir)

    def predict(self, rows: list[dict]) -> list[dict]:
        return [{"locations": [(i, *g) for i, b in enumerate(r["boxes"]) if (g := kernels.mask_geometry(self.model.masks(r["image"], b)[0]))]} for r in rows]

    def close(self) -> None:
        self.model = None
        gc.collect()


class Generator:
    """An image from a prompt and a control image."""

    options = vocab.GENERATION_OPTIONS

    def __init__(self, backend: Callable[..., object] = PixelPainter, cache_dir: str | None = None):
        self.backend, self.cache_dir, self.model = backend, cache_dir, None

    def open(self) -> None:
        self.model = made(self.backend, self.cache_dir)

    def predict(self, rows: list[dict]) -> list[dict]:
        return [{"image": self.model.paint(r["prompt"], r["control"], negative_prompt=vocab.NEGATIVE_PROMPT, **self.options)} for r in rows]

    def close(self) -> None:
        self.model = None
        gc.collect()


#: The captioner of each model of a benchmark.
REGISTRY: dict[str, Callable[[], Provider]] = {"qwen2vl_2b": DetailCaptioner, "internvl2_4b": ChatCaptioner, "llava_onevision_7b": TemplateCaptioner, "internvl3_8b": ChatCaptioner}


def from_table(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions made before, (image_name, caption), in place of a model's: a join, of any size; none gives an error."""
    known = captions.select("image_name", F.col("caption").cast("string").alias("caption")).dropDuplicates(["image_name"])
    rows = images.join(known, "image_name", "left")
    return rows.withColumn("inference_time", F.lit(0.0)).withColumn("error", F.when(F.col("caption").isNull(), F.lit("no caption")))


def ask(provider: Provider, rows: list[dict]) -> list[tuple[dict, str | None]]:
    """What the provider says to each row, and why not. Where rows fail together, each is tried alone."""
    if not rows:
        return []
    try:
        said = provider.predict(rows)
        if len(said) != len(rows):
            raise ValueError(f"{len(said)} replies to {len(rows)} rows")
        return [(got, None) for got in said]
    except Exception as e:  # noqa: BLE001  a bad row must not end the job
        return [({}, str(e) or type(e).__name__)] if len(rows) == 1 else [x for r in rows for x in ask(provider, [r])]


#: Images that a benchmark's model gets at once, at most.
AT_ONCE = 32


def benchmark(decoded: DataFrame, models: dict[str, Callable[[], Provider]]) -> DataFrame:
    """(origin, image_name, model_key, caption, inference_time, error, model_error): each model on each decoded image.

    Each model makes a pass of its own over the images: so a task opens one model, once, as only one may fit into memory, and
    the model gets images together, AT_ONCE at most. If it can't be opened, its rows have model_error.
    """
    parts = [_replies(decoded, key, make) for key, make in models.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("caption", F.coalesce("caption", expr.error_caption(F.col("error"))))


def _replies(decoded: DataFrame, key: str, make: Callable[[], Provider]) -> DataFrame:
    """One model on each decoded image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, broken = None, None
        try:
            provider = make()
            provider.open()
        except Exception as e:  # noqa: BLE001
            broken = str(e) or type(e).__name__
        try:
            for pdf in (whole.iloc[at : at + AT_ONCE] for whole in batches for at in range(0, len(whole), AT_ONCE)):
                images = [kernels.array_of(r.height, r.width, r.n_channels, r.data) if r.height > 0 else None for r in pdf.itertuples(index=False)]
                asked = [] if broken else [i for i, x in enumerate(images) if x is not None]
                said = dict(zip(asked, ask(provider, [{"image": images[i]} for i in asked]))) if asked else {}
                rows = []
                for i, r in enumerate(pdf.itertuples(index=False)):
                    got, error = said.get(i, ({}, broken or "not an image"))
                    rows.append((r.origin, r.image_name, key, got.get("caption"), got.get("inference_time", 0.0), error, broken))
                yield pd.DataFrame(rows, columns=["origin", "image_name", "model_key", "caption", "inference_time", "error", "model_error"])
        finally:
            if provider and not broken:
                provider.close()

    return decoded.select("origin", "image_name", "height", "width", "n_channels", "data").mapInPandas(run, "origin string, image_name string, model_key string, caption string, inference_time double, error string, model_error string")
