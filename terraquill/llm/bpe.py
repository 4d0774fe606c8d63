"""BPE encoding and decoding of whole texts, with content-defined chunks that documents share encoded once.

1. A rolling hash over 16 bytes cuts texts to chunks (one cut in 2^BITS bytes), so equal passages are cut alike wherever
   they stand. A chunk's body lies between the first and the last place in it where white space (a blank or line feed)
   begins after a printed ASCII character: no token reaches over such a place, so a body's ids don't depend on its context.
2. Bodies are counted by hash, in partial sums; no text is shuffled for this. Of those met more than once, the ones whose
   reuse saves most, up to HELD bytes, make the dictionary: Spark gathers one copy of each and encodes it once, and the
   dictionary (bounded by HELD, whatever the input) is sent to all tasks. Repeated bodies beyond it are encoded where they
   stand, as others are; results don't depend on that.
3. A text takes the ids of its chunks' bodies from the dictionary (found by their bytes, so a hash that two bodies share
   does no harm). Joins are repaired: from the end of one known body to the beginning of the next, whatever lies between
   is encoded again as one piece, up to the places where both agree exactly.

Where the tokenizer drops white space, a piece is cut at blanks, and a word's ids are remembered by the task (WORDS at most,
then forgotten), as are those of the tokenizer's own words in it; unseen ones go to the library, those of ASCII and Latin
letters many at once, told apart again by the tokens that end a word. For other vocabularies the library encodes whole pieces. Decoding is the library's: with a decoder
in the file by the library itself, without one the tokens joined by a blank.

The vocabulary file is a parameter. It must cut texts where white space begins: a file with an added prefix blank, a
post-processor, truncation, padding, dropout or added tokens that take blanks is refused. Special tokens in a text become
their ids, as in the library; none are added.

Defined results: null and empty texts have no ids, and an empty decoded text; repeated rows get equal results; an empty
table gives an empty result; columns of the same names as new ones are replaced, others are kept. Lost executors cost
their own tasks: nothing but sums and the dictionary's bodies is shuffled.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm.runtime import small_batches, tidy
from terraquill.llm.textkit import chunks, content_cuts, plain_hashes

BITS, HELD, WORDS = 8, 16 << 20, 300_000
#: A body of fewer bytes costs as much to look up as to encode.
LEAST = 32
#: Characters that normalisation changes by their lower case only and that every Unicode version puts in the same class.
_SIMPLE = regex.compile(r"[\t\n\r\x20-\x7EÀ-įı-ž]*+")
_BLANKS = regex.compile(r"[\t\n\r ]+")


class Coder:
    """A vocabulary file, and the words that its task met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if spec["pre_tokenizer"] else []
        post = spec["post_processor"]
        if not parts or spec["model"].get("dropout") or (post and post["type"] != "ByteLevel") or any(p.get("add_prefix_space") for p in parts) or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("the vocabulary's words don't stand apart at white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())] if not spec["decoder"] else None
        first, suffix = parts[0], spec["model"].get("end_of_word_suffix")
        drops = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        apart = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
        #: Cuts a word at white space to those of the tokenizer, where it drops white space and marks the ends of words.
        self.words = regex.compile(first["pattern"]["Regex"]).findall if apart and suffix and spec["normalizer"] and spec["normalizer"].get("normalizers") == drops else None
        self.last = np.array([t.endswith(suffix) for t in self.tokens]) if self.words and self.tokens else None
        self.words = self.words if self.last is not None else None
        self.memory: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        if not self.words:
            return list(self._library(pieces))
        split = [p.split() if _SIMPLE.fullmatch(p) else _BLANKS.split(p) for p in pieces]
        if len(self.memory) > WORDS:
            self.memory = {}
        if len(self.parts) > WORDS:
            self.parts = {}
        known = self.memory
        new = list({w for words in split for w in words if w not in known})
        plain = set(_SIMPLE.fullmatch("\n".join(new)) and new or [w for w in new if _SIMPLE.fullmatch(w)])
        for s in self.special:
            plain -= {w for w in plain if s in w}
        self._learn(list(plain))
        other = [w for w in new if w not in known]
        known.update(zip(other, self._library(other)))
        return [b"".join([known[w] for w in words]) for words in split]

    def _learn(self, words: list[str]) -> None:
        """Remembers words between blanks by the tokenizer's own, which are encoded many as one text; each of them ends with a
        token that has the suffix."""
        known, cut = self.parts, [self.words(w.lower()) for w in words]
        new = list({p for parts in cut for p in parts if p not in known})
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = np.frombuffer(next(self._library([" ".join(some)])), "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, [0, *ends], ends))
            else:
                known.update(zip(some, self._library(some)))
        self.memory.update((w, b"".join([known[p] for p in parts])) for w, parts in zip(words, cut))

    def _library(self, pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), 1000):
            for e in self.tokenizer.encode_batch_fast(pieces[at : at + 1000], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def decoded(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokens is None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in numbers])


@lru_cache(2)
def coder(path: str) -> Coder:
    """A task's own; workers keep it for their next tasks."""
    return Coder(path)


def bodies(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the bodies of the chunks of some texts, one after the other in `data`, begin and end."""
    cuts = content_cuts(data, offsets, bits)
    gap = (data == 0x20) | (data == 0x0A)
    gap[1:] &= (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    gap[:1] = False
    gap[offsets[:-1][offsets[:-1] < len(data)]] = False
    places = np.flatnonzero(gap)
    if not len(places):
        return places, places
    left, right = np.searchsorted(places, cuts[:-1], "right"), np.searchsorted(places, cuts[1:], "left") - 1
    some = left < right
    begin, end = places[left[some]], places[right[some]]
    long = end - begin >= LEAST
    return begin[long], end[long]


def repeated(df: DataFrame, text: str, bits: int, held: int) -> np.ndarray:
    """Hashes of the bodies met more than once whose reuse saves most, `held` bytes at most, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in chunks(batch.column(0)):
                begin, end = bodies(data, offsets, bits)
                found.append(plain_hashes(data, begin, end)), sizes.append(end - begin)
            h, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(np.concatenate(sizes)[first])], ["h", "n", "size"])

    counts = df.select(text).mapInArrow(tidy(run), "h long, n long, size long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    best = counts.where("n > 1").orderBy(F.desc(F.expr("(n - 1) * size")), "h").limit(held // LEAST // 4).select("h", "size").toPandas()
    return np.sort(best["h"].to_numpy(np.int64)[np.cumsum(best["size"].to_numpy(np.int64)) <= held])


def dictionary(df: DataFrame, text: str, path: str, bits: int = BITS, held: int = HELD) -> dict[bytes, bytes]:
    """Ids by body, for the bodies that are worth it; each is encoded once."""
    wanted = repeated(df, text, bits, held)
    if not len(wanted):
        return {}
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, np.zeros(len(shared.value), bool)
        for batch in batches:
            found, own = [], []
            for _, _, data, offsets in chunks(batch.column(0)):
                begin, end = bodies(data, offsets, bits)
                h = plain_hashes(data, begin, end).view(np.int64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for i in np.flatnonzero((known[at] == h) & ~seen[at]).tolist():
                    if not seen[at[i]]:
                        seen[at[i]] = True
                        found.append(data[begin[i] : end[i]].tobytes()), own.append(h[i])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.binary())], ["h", "body"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_bodies = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder(path).encoded([b.decode() for b in held_bodies]), pa.binary())], ["body", "ids"])

    once = df.select(text).mapInArrow(tidy(copies), "h long, body binary").groupBy("h").agg(F.min("body").alias("body"))
    return {bytes(r["body"]): bytes(r["ids"]) for r in once.select("body").mapInArrow(tidy(encode), "body binary, ids binary").toLocalIterator()}


def _pieces(data: np.ndarray, offsets: np.ndarray, bits: int, known: dict[bytes, bytes]) -> Iterator[list[bytes | str]]:
    """For each text its parts in order: ids of known bodies, and the text between them."""
    begin, end = bodies(data, offsets, bits)
    raw = data.tobytes()
    firsts = np.searchsorted(begin, offsets)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        parts: list[bytes | str] = []
        at = a
        if known:
            for x, y in zip(begin[firsts[i] : firsts[i + 1]].tolist(), end[firsts[i] : firsts[i + 1]].tolist()):
                ids = known.get(raw[x:y])
                if ids is not None:
                    if x > at:
                        parts.append(raw[at:x].decode())
                    parts.append(ids)
                    at = y
        if b > at:
            parts.append(raw[at:b].decode())
        yield parts


def encode(df: DataFrame, path: str, text: str = "text", bits: int = BITS, held: int = HELD) -> DataFrame:
    """df with ids, binary (little-endian unsigned 32-bit integers), and decoded, the text that they decode to."""
    spark = df.sparkSession
    small_batches(spark)
    new = ["ids", "decoded"]
    kept = [c for c in df.columns if c not in new]
    place = kept.index(text)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*(F.col(f"`{c}`") for c in kept)).dtypes)
    shared = spark.sparkContext.broadcast(dictionary(df, text, path, bits, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value, coder(path)
        for batch in batches:
            ids, texts = [], []
            for _, _, data, offsets in chunks(batch.column(place)):
                rows = list(_pieces(data, offsets, bits, known))
                fresh = iter(own.encoded([p for parts in rows for p in parts if isinstance(p, str)]))
                for parts in rows:
                    ids.append(b"".join([next(fresh) if isinstance(p, str) else p for p in parts]))
                    texts.append(own.decoded(ids[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [*kept, *new])

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(tidy(run), f"{fields}, ids binary, decoded string")


def digest(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every document."""
    coded = encode(documents.select("doc_id", "text"), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
