"""Image kernels on numpy arrays (height, width, channels), and the Arrow functions that apply them to decoded rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terraquill import vocab

#: Bytes of results beyond which a task hands them on.
HELD_BYTES = 4 << 20


def _cubic(x: np.ndarray) -> np.ndarray:
    """Keys' cubic convolution kernel with a = -0.5."""
    x = np.abs(x)
    near = (1.5 * x - 2.5) * x * x + 1
    far = ((-0.5 * x + 2.5) * x - 4) * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def weights(old: int, new: int) -> np.ndarray:
    """(new, old) resampling weights; when shrinking the kernel widens with the scale (antialias)."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    w = _cubic((np.arange(old)[None, :] - centre[:, None]) / scale)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic, clamped to 0..255 (overshoot never wraps). A channel at a time, so one channel's doubles are held."""
    tall, wide = weights(image.shape[0], height), weights(image.shape[1], width).T
    out = np.empty((height, width, image.shape[2]), np.uint8)
    for i in range(image.shape[2]):
        x = tall @ image[..., i].astype(np.float64) @ wide
        np.rint(x, out=x)
        np.clip(x, 0, 255, out=x)
        out[..., i] = x
    return out


def upscale(image: np.ndarray, factor: int = vocab.UPSCALE) -> np.ndarray:
    return resize(image, image.shape[0] * factor, image.shape[1] * factor)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image in 16-bit fixed point."""
    if image.shape[2] == 1:
        return image[..., 0]
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def _ring(image: np.ndarray, offset: int) -> np.ndarray:
    """8 at the centre, -1 around, plus offset; border pixels are copied."""
    x = image.astype(np.int64)
    out = x.copy()
    if min(x.shape) > 2:
        box = sum(x[1 + dy : x.shape[0] - 1 + dy, 1 + dx : x.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[1:-1, 1:-1] = 9 * x[1:-1, 1:-1] - box + offset
    return np.clip(out, 0, 255).astype(np.uint8)


def stretch(image: np.ndarray) -> np.ndarray:
    """Linear stretch of the range of values to 0..255; a constant image stays."""
    lo, hi = int(image.min()), int(image.max())
    if hi <= lo:
        return image
    return np.clip((image.astype(np.float64) - lo) * (255.0 / (hi - lo)), 0, 255).astype(np.uint8)


def _threefold(channel: np.ndarray) -> np.ndarray:
    """(height, width, 1) as three equal channels."""
    out = np.empty((*channel.shape[:2], 3), channel.dtype)
    for i in range(3):  # far faster than one assignment to all
        out[..., i] = channel[..., 0]
    return out


def _edges(image: np.ndarray) -> np.ndarray:
    return stretch(_ring(_ring(gray(image), 0), 255))[..., None]


def control_map(image: np.ndarray) -> np.ndarray:
    """Edges, then contours, stretched, as three equal channels."""
    return _threefold(_edges(image))


def control_image(image: np.ndarray, size: int = vocab.OUTPUT_SIZE) -> np.ndarray:
    """The control map, resized to size x size; its channels are equal, so one of them is."""
    return _threefold(resize(_edges(image), size, size))


def preprocess(image: np.ndarray, size: int = vocab.MODEL_SIZE) -> np.ndarray:
    """RGB, size x size, normalised, channels first, float32. A channel has 256 values, so each is normalised once."""
    own = resize(image if image.shape[2] == 1 else image[..., 2::-1], size, size)
    values = (np.arange(256, dtype=np.uint8).astype(np.float32)[:, None] / 255 - np.float32(vocab.IMAGE_MEAN)) / np.float32(vocab.IMAGE_STD)
    return np.stack([values[:, i].take(own[..., i % own.shape[2]]) for i in range(3)])


def mask_geometry(mask: np.ndarray) -> tuple[int, int, int] | None:
    """Centre x, centre y and area of a mask; None if it is empty."""
    y, x = np.nonzero(mask > vocab.MASK_ABOVE)
    return (int(x.mean()), int(y.mean()), len(x)) if len(x) else None


def png(image: np.ndarray) -> bytes:
    """PNG of a BGR or one-channel image."""
    h, w, c = image.shape
    rows = image[..., 2::-1] if c >= 3 else image
    raw = b"".join(b"\0" + rows[i].tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c >= 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """The BGR or one-channel image of a PNG that `png` made."""
    width, height, _, kind = struct.unpack(">IIBB", data[16:26])
    at, packed = 8, b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        packed += data[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += size + 12
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, -1)[:, 1:]
    image = rows.reshape(height, width, 3 if kind == 2 else 1)
    return image[..., ::-1] if kind == 2 else image


def array_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., : 3 if channels >= 3 else 1]


def apply(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], digest: bool = False) -> DataFrame:
    """Decoded rows with data, height, width and n_channels replaced by the kernel's result, one image at a time.

    An image that can't be decoded, or at which the kernel fails, stays as it is and gets its reason in `error`. digest: in
    place of data the hexadecimal SHA-256 of it, made in the task, so results that nobody reads don't leave it.
    """
    names = ["origin", "image_name", "height", "width", "n_channels", "data"]
    kept = (lambda data: None if data is None else sha256(data).hexdigest()) if digest else (lambda data: data)
    columns = [*names[:-1], "digest" if digest else "data", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for r in pdf.itertuples(index=False):
                try:
                    if r.height < 1:
                        raise ValueError("not an image")
                    out = np.ascontiguousarray(kernel(array_of(r.height, r.width, r.n_channels, r.data)))
                    row = (r.origin, r.image_name, *out.shape, kept(out.tobytes()), None)
                except Exception as e:  # noqa: BLE001  a bad image must not end the job
                    row = (r.origin, r.image_name, r.height, r.width, r.n_channels, kept(r.data), str(e))
                rows.append(row)
                held += len(row[5] or b"")
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return images.select(*names).mapInPandas(run, f"origin string, image_name string, height int, width int, n_channels int, {columns[5]} {'string' if digest else 'binary'}, error string")
