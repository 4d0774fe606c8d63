"""Column builders for captions, prompts and detections. All are built-in expressions that Catalyst can compile."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraquill import vocab
from terraquill.vocab import Template


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_caption(c: Column) -> Column:
    """Stripped, `Aerial view` where the model gave nothing, then without each boilerplate phrase in turn."""
    return reduce(lambda x, phrase: F.replace(x, F.lit(phrase), F.lit("")), vocab.BOILERPLATE, F.coalesce(strip(c), F.lit(vocab.NO_OUTPUT_CAPTION)))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def number_count(c: Column) -> Column:
    """Runs of digits that stand alone."""
    return F.regexp_count(c, F.lit(r"\b\d+\b")).cast("long")


def token_estimate(words: Column) -> Column:
    return F.floor(words * F.lit(vocab.TOKENS_PER_WORD)).cast("long")


def length_score(words: Column) -> Column:
    return F.when(words < 20, 0.3).when(words < 50, 0.6).when(words < 150, 1.0).otherwise(0.8)


def share(n: Column, full: int) -> Column:
    return F.least(n / F.lit(float(full)), F.lit(1.0))


def overall(length: Column, quantification: Column, spatial: Column, structures: Column) -> Column:
    parts = {"length": length, "quantification": quantification, "spatial": spatial, "structures": structures}
    return reduce(add, (parts[k] * F.lit(w) for k, w in vocab.QUALITY_WEIGHTS.items()))


def combined_score(quality: Column, keywords: Column, seconds: Column) -> Column:
    return quality * F.lit(0.5) + keywords / F.lit(10.0) * F.lit(0.3) + F.lit(1.0) / (seconds + F.lit(1.0)) * F.lit(0.2)


def grid_position(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The name of the third of the image in which a point lies; a point on the far edge counts to the last third."""
    column, row = (F.least(F.floor(p / (size / F.lit(3.0))), F.lit(2)) for p, size in ((x, width), (y, height)))
    return F.element_at(F.array(*map(F.lit, vocab.POSITIONS)), (row * 3 + column + 1).cast("int"))


def relative_size(area: Column, width: Column, height: Column) -> Column:
    return area / (width * height).cast("double")


def size_class(relative: Column) -> Column:
    return F.when(relative > vocab.LARGE_ABOVE, "large").when(relative > vocab.MEDIUM_ABOVE, "medium").otherwise("small")


def enhanced_summary(summary: Column, spatial: Column) -> Column:
    return F.when(F.coalesce(spatial, F.lit("")) != "", F.concat(summary, F.lit(f". {vocab.LAYOUT_MARK} "), spatial)).otherwise(summary)


def spatial_extract(summary: Column) -> Column:
    """What follows the last layout mark, stripped; empty without one."""
    return F.when(F.contains(summary, F.lit(vocab.LAYOUT_MARK)), strip(F.substring_index(summary, vocab.LAYOUT_MARK, -1))).otherwise(F.lit(""))


def combine_prompt(caption: Column, counts: Column, total: Column, summary: Column, template: Template = vocab.PRODUCTION) -> Column:
    """The prompt of an image from its caption, counts text, total and (enhanced) summary.

    An image without detections (empty counts or total 0) gets the plain prompt. Where something is missing (null counts or,
    with detections, a null caption or summary), the fallback: the plain prompt and what there is of the summary. A null caption shows as NO_CAPTION.
    """
    plain = F.concat(F.lit("Aerial view: "), F.coalesce(caption, F.lit(vocab.NO_CAPTION)))
    layout = spatial_extract(summary)
    tail = F.when(layout != "", F.concat(F.lit(template.layout), layout)).when(summary != "", F.concat(F.lit(". "), summary)).otherwise(F.lit(""))
    full = F.concat(F.lit(template.lead), F.lower(caption), F.lit(template.counts), counts, tail, F.lit(template.suffix))
    fallback = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(plain, F.lit(", "), summary)).otherwise(plain)
    none = (counts == "") | (F.coalesce(total, F.lit(1)) == 0)
    return F.when(counts.isNull(), fallback).when(none, plain).when(caption.isNull() | summary.isNull(), fallback).otherwise(full)


def assistant_reply(response: Column) -> Column:
    """What follows the last `assistant`, where the word occurs in any case; else the whole response."""
    return F.when(F.contains(F.lower(response), F.lit("assistant")), strip(F.substring_index(response, "assistant", -1))).otherwise(response)


def failed_caption(error: Column) -> Column:
    return F.concat(F.lit("[Generation failed: "), F.substring(error, 1, 50), F.lit("]"))


def error_caption(error: Column) -> Column:
    return F.concat(F.lit("ERROR: "), error)


def preview(c: Column, n: int) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot does not begin one."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def output_path(root: str, folder: str, name: Column, ending: str) -> Column:
    return F.concat(F.lit(f"{root}/{folder}/"), name, F.lit(ending))


def class_prompt(labels: Column | None = None) -> Column:
    """All classes, or those of `labels`, in the vocabulary's order."""
    known = F.array(*map(F.lit, vocab.DETECT_CLASSES))
    return F.array_join(known if labels is None else F.filter(known, lambda c: F.array_contains(labels, c)), " . ")


def chat(image: Column, prompt: str) -> Column:
    """One user message with an image and a text."""
    none = F.lit(None).cast("string")
    part = lambda kind, i, t: F.struct(F.lit(kind).alias("type"), i.alias("image"), t.alias("text"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(part("image", image, none), part("text", none, F.lit(prompt))).alias("content")))


def gib(n: Column) -> Column:
    return n / F.lit(float(1024**3))


def trimmed_tokens(prompt: Column, out: Column) -> Column:
    """Generated token ids without the echoed prompt."""
    return F.slice(out, F.size(prompt) + 1, F.greatest(F.size(out) - F.size(prompt), F.lit(0)))


def reversed_size(size: Column) -> Column:
    """(width, height) as (height, width)."""
    return F.reverse(size)


def fixed(c: Column, places: int) -> Column:
    """A number as text for reports. For display only: on ties Java rounds half up."""
    return F.format_string(f"%.{places}f", c)
