"""Where a run reads and writes, from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, otherwise: str):
    return field(default_factory=lambda: os.environ.get(name) or otherwise)


@dataclass(frozen=True)
class Config:
    """The names and defaults of the variables. Limits of 0 mean all images."""

    input_dir: str = _env("INPUT_DIR", "datasets/rsicd_images")
    output_dir: str = _env("OUTPUT_DIR", "outputs/pipeline_results")
    benchmark_dir: str = "outputs/vlm_benchmark"
    #: The folder of weights, for `providers.with_cache`; the backends here keep none.
    cache_dir: str = _env("HF_CACHE_DIR", "./hf_cache")
    max_images: int = 1
    test_images: int = 5
