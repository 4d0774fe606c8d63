"""Vocabularies, templates and thresholds: fixed values that results depend on."""

from __future__ import annotations

from typing import NamedTuple

# Fixed values.
DETECT_CLASSES = (
    "building", "house", "road", "street", "highway", "vehicle", "car", "tree", "forest", "water", "river", "pond",
    "lake", "field", "farmland", "airplane", "ship", "boat", "bridge", "parking lot", "factory", "warehouse",
    "residential area", "commercial area", "industrial area", "park", "garden", "railway", "stadium", "airport",
    "harbor", "port",
)
AERIAL_KEYWORDS = (
    "aerial", "satellite", "overhead", "bird's eye", "top-down", "building", "house", "road", "street", "vehicle",
    "car", "tree", "forest", "water", "river", "field", "residential", "urban", "rural", "industrial", "commercial",
    "parking", "rooftop", "roof", "dense", "sparse", "grid", "pattern",
)
SPATIAL_TERMS = ("left", "right", "center", "top", "bottom", "corner", "middle", "surrounding", "adjacent", "between")
STRUCTURE_TERMS = ("building", "house", "road", "street", "tree", "vehicle", "water", "field")
POSITIONS = ("top-left", "top-center", "top-right", "middle-left", "center", "middle-right", "bottom-left", "bottom-center", "bottom-right")
BOILERPLATE = ("The image shows ", "The scene shows ", "This is ", "It is ")
NO_OUTPUT_CAPTION = "Aerial view"
FAILED_CAPTION = "Aerial landscape view"
NO_CAPTION = "None"
LAYOUT_MARK = "Spatial layout:"
SCORE_LEAST = 0.25
MASK_ABOVE = 0.5
LARGE_ABOVE, MEDIUM_ABOVE = 0.15, 0.05
TOP_LABELS, TOP_POSITIONS = 3, 5
UPSCALE = 4
OUTPUT_SIZE = 1024
MODEL_SIZE = 448
TOKENS_PER_WORD, TOKEN_LIMIT = 1.3, 512
QUALITY_WEIGHTS = {"length": 0.2, "quantification": 0.3, "spatial": 0.25, "structures": 0.25}
IMAGE_MEAN, IMAGE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
# What models are asked, and with what options.
SCENE_QUESTION = "Describe this aerial image concisely in 2-3 sentences: scene type, main structures, and key features."
DETAIL_QUESTION = "Describe this aerial/satellite image in detail. Include: scene type, main structures, objects with approximate counts, spatial layout, and notable features."
SCENE_OPTIONS = {"max_new_tokens": 60, "do_sample": True, "temperature": 0.5, "top_p": 0.85}
DETAIL_OPTIONS = {"max_new_tokens": 200, "do_sample": True, "temperature": 0.5, "top_p": 0.85}
CHAT_OPTIONS = {"max_new_tokens": 200, "do_sample": True, "temperature": 0.5}
GENERATION_OPTIONS = {"num_inference_steps": 35, "guidance_scale": 7.5, "controlnet_conditioning_scale": 0.6, "height": 1024, "width": 1024}
NEGATIVE_PROMPT = (
    "cartoon, anime, illustration, drawing, painting, artistic, stylized, 3d render, cgi, digital art, oversaturated, vibrant colors, "
    "bright green, neon colors, perfect, clean, pristine, new buildings, uniform appearance, video game, miniature, tilt-shift, HDR, overprocessed"
)
STAGE_MODELS = {
    "upscaler": "PyTorch-Bicubic",
    "caption": "Qwen/Qwen2-VL-2B-Instruct",
    "detection": "IDEA-Research/grounding-dino-base",
    "localizer": "facebook/sam-vit-base",
    "combiner": "Template-based",
    "generation": "stabilityai/stable-diffusion-xl-base-1.0",
    "controlnet": "diffusers/controlnet-canny-sdxl-1.0",
}


class Model(NamedTuple):
    key: str
    name: str
    memory_gb: float


# Fixed values; the memory of each is an example, as it is measured where a model runs.
MODELS = (
    Model("qwen2vl_2b", "Qwen/Qwen2-VL-2B-Instruct", 4.5),
    Model("internvl2_4b", "OpenGVLab/InternVL2-4B", 8.25),
    Model("llava_onevision_7b", "llava-hf/llava-onevision-qwen2-7b-ov-hf", 15.5),
    Model("internvl3_8b", "OpenGVLab/InternVL3-8B", 16.75),
)


class Template(NamedTuple):
    lead: str
    counts: str
    layout: str
    suffix: str


# Fixed values.
PRODUCTION = Template(
    "Satellite photograph of ",
    " with ",
    ". Layout: ",
    ". Real satellite imagery, muted natural colors, weathered rooftops, dusty appearance, overhead view, nadir angle, natural shadows, varied building conditions, realistic urban textures, Google Maps satellite view.",
)
FIRST_VERSION = Template("Aerial view of ", " featuring ", ". Spatial distribution: ", ". High quality aerial photography, detailed, sharp focus.")
