"""Token counts by trie-shared dynamic programming over a unigram model.

A text's pre-tokens are its runs without white space, each marked by the word-start sign. A worker keeps the distinct
pre-tokens it has seen in a trie, over all its tasks of one query. A node of the trie is a prefix, reached by one character
from the node above, and holds its forward score: the best sum of log probabilities of vocabulary pieces that spell it, with
the number of tokens in that spelling (ties: fewer tokens). A new pre-token goes down the nodes that earlier ones share and
computes only those below (an automaton finds the pieces that end there); the count at its end is its terminal count, and a
text's count is the sum of its pre-tokens' terminal counts. No row is shuffled. The nodes are dropped and begun anew when
they are more than NODES, and so are the terminal counts; pre-tokens longer than LONG are scored by the same recursion
without being kept.

The vocabulary file (piece_bpe_32k.model by default; a parameter) is read on the driver, never trained, and broadcast: its
size is fixed. It ranks pieces and states no probabilities, so the unigram model takes Zipf's law, p ~ 1 / rank. A character
that is no piece costs as many tokens as it has UTF-8 bytes.

Defined results: null, empty and blank texts have 0 tokens; repeated rows get equal counts; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from terraquill.llm.runtime import tidy

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
NODES, LONG, BLOCK = 800_000, 64, 1 << 16
CODES = 0x110000
START = "▁"
#: How far a character outside the vocabulary lies below the rarest piece.
UNKNOWN = 10.0


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Log probabilities of the pieces of a vocabulary file, by Zipf's law on their order; control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}


class _Terminals(dict):
    """Counts by pre-token; one that isn't there is inserted in the trie."""

    def __init__(self, insert: Callable[[str], int]):
        super().__init__()
        self.insert = insert

    def __missing__(self, word: str) -> int:
        return self.insert(word)


def _bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


class Trie:
    """Forward scores and token counts of shared prefixes. Nodes are numbers; 0 is the root."""

    def __init__(self, vocabulary: dict[str, float], nodes: int = NODES):
        self.nodes = nodes
        self.most = max(map(len, vocabulary), default=1)
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN
        #: Finds the pieces that end at each character of a word.
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.terminal = _Terminals(self.insert)
        self.clear()

    def clear(self) -> None:
        #: By node * CODES + character, the node below; by node, its score and its count.
        self.below: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The terminal count of a pre-token."""
        marked = START + word
        if len(marked) > LONG:
            return self._long(marked)
        node, path, below = 0, [0], self.below
        for c in marked:
            node = below.get(node * CODES + ord(c))
            if node is None:
                self._extend(marked, path)
                break
            path.append(node)
        self.terminal[word] = tokens = self.count[path[-1]]
        return tokens

    def _extend(self, marked: str, path: list[int]) -> None:
        """Adds the nodes of a word below path, the nodes of its prefix that are there."""
        below, score, count = self.below, self.score, self.count
        i = known = len(path) - 1
        top, tokens, single = -math.inf, 0, False
        # (size, None) ends the last node.
        for end, piece in chain(self.pieces.iter(marked, max(0, known + 1 - self.most)), ((len(marked), None),)):
            if end < known:
                continue
            while i < end:
                above = path[i]
                if not single and (s := score[above] + self.unknown) > top:
                    top, tokens = s, count[above] + _bytes(marked[i])
                below[above * CODES + ord(marked[i])] = new = len(score)
                path.append(new), score.append(top), count.append(tokens)
                i, top, single = i + 1, -math.inf, False
            if piece is None:
                break
            n, own = piece
            single = single or n == 1
            start = path[end + 1 - n]
            s, t = score[start] + own, count[start] + 1
            if s > top or (s == top and t < tokens):
                top, tokens = s, t

    def _long(self, marked: str) -> int:
        """The same recursion; of the scores only those within a piece's reach are held."""
        held, i, best = [(0.0, 0)], 0, None
        for end, piece in chain(self.pieces.iter(marked), ((len(marked), None),)):
            while i < end:
                if best is None:
                    best = held[-1][0] + self.unknown, -held[-1][1] - _bytes(marked[i])
                held.append((best[0], -best[1]))
                if len(held) > 2 * self.most:
                    del held[: self.most]
                i, best = i + 1, None
            if piece is not None:
                s, t = held[-piece[0]]
                if best is None and piece[0] > 1:
                    best = held[-1][0] + self.unknown, -held[-1][1] - _bytes(marked[i])
                own = s + piece[1], -t - 1
                best = own if best is None else max(best, own)
        return held[-1][1]

    def tokens(self, words: list[str]) -> int:
        if len(self.score) > self.nodes:
            self.clear()
        if len(self.terminal) > self.nodes:
            self.terminal = _Terminals(self.insert)
        return sum(map(self.terminal.__getitem__, words))


class _Shared(NamedTuple):
    table: Broadcast
    id: str
    nodes: int

    @property
    def value(self) -> dict[str, float]:
        return self.table.value


_kept: dict[str, Trie] = {}


def _trie(shared: _Shared) -> Trie:
    """The worker's trie for a broadcast vocabulary; later tasks of the same worker go on with it."""
    if shared.id not in _kept:
        _kept.clear()
        _kept[shared.id] = Trie(shared.value, shared.nodes)
    return _kept[shared.id]


def _blocks(text: str) -> Iterator[list[str]]:
    if len(text) <= 1 << 20:
        yield text.split()
        return
    found = (m.group() for m in re.finditer(r"\S+", text))
    while block := list(islice(found, BLOCK)):
        yield block


def count(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, nodes: int = NODES) -> DataFrame:
    """df without its text, with n_words and n_tokens (long). nodes: the most that a worker's trie has; fewer take less memory
    and more time."""
    shared = _Shared(df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary)), uuid.uuid4().hex, nodes)
    kept = [c for c in df.columns if c not in (text, "n_words", "n_tokens")]
    fields = "".join(f"`{c}` {t}, " for c, t in df.dtypes if c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared)
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(len(kept)):
                w = n = 0
                for block in _blocks(t.as_py() or ""):
                    w += len(block)
                    n += trie.tokens(block)
                words.append(w), tokens.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [*kept, "n_words", "n_tokens"])

    return df.select(*kept, text).mapInArrow(tidy(run), f"{fields}n_words long, n_tokens long")


def count_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every document."""
    return count(documents.select("doc_id", "text"), "text", vocabulary)
