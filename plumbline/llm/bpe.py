"""BPE encoding with forced boundaries, and decoding.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be merged
over, so a word is certainly cut between them. Its fragments are encoded on their own and their ids
joined; a worker remembers the fragments and pieces it has met.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import carried, slices

# white space of the tokenizer's regular expressions: the Unicode property White_Space
WHITE = "\t-\r \x85\xa0  -     　"
ONLY_PYTHON_WHITE = re.compile("[\x1c-\x1f]")  # str.split takes these for white space too
MEMORY_BYTES = 24 << 20  # of one generation of a worker's memory
ENTRY_BYTES = 200  # of an entry beside its key and value: two objects and a place in the table
LONG = 64  # characters; longer pieces are not remembered, and merged with a queue
NO_RANK = 1 << 40


def byte_characters() -> dict[int, str]:
    """Byte to printable character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file with an end-of-word suffix, NFC, white-space folding and lower case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("this kind of tokenizer file is not supported")
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens = token_list(spec)
        # the two ids of a pair and the rank with the merged id, packed into an integer each
        self.rank = {
            self.ids[a] << 20 | self.ids[b]: r << 20 | self.ids[a + b] for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        }
        self.character = byte_characters()
        code = {c: b for b, c in self.character.items()}
        self.inside = np.zeros((256, 256), bool)
        for token in self.ids:
            body = [code[c] for c in token.removesuffix(self.suffix)]
            self.inside[body[:-1], body[1:]] = True
        self.cuts = {bytes(p) for p in np.argwhere(~self.inside).tolist()}
        self.starts = [self.ids[c] for _, c in sorted(self.character.items())]
        self.ends = [self.ids[c + self.suffix] for _, c in sorted(self.character.items())]
        self.fragments, self.words, self.pieces = Memory(self.fragment), Memory(self.word), Memory(self.piece)

    def fragments_of(self, word: bytes) -> list[bytes]:
        """The word cut at every pair of bytes that no token holds."""
        if len(word) <= LONG:
            cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] in self.cuts]
        else:
            a = np.frombuffer(word, np.uint8)
            cuts = (np.flatnonzero(~self.inside[a[:-1], a[1:]]) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def fragment(self, key: tuple[bytes, bool]) -> list[int]:
        """Ids of a fragment, with the word-end suffix if it is the last one: merges by rank, the leftmost of equal rank first."""
        body, last = key
        ids = [self.starts[b] for b in body]
        if last:
            ids[-1] = self.ends[body[-1]]
        if len(ids) > LONG:
            return self.merge_queued(ids)
        rank = self.rank.get
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NO_RANK:
            i = ranks.index(best)
            ids[i : i + 2] = (best & 0xFFFFF,)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NO_RANK)
        return ids

    def merge_queued(self, ids: list[int | None]) -> list[int]:
        """The same merges for a long fragment, n log n."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(self.rank[p], i, p) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (p := a << 20 | b) in self.rank]
        heapq.heapify(queue)
        while queue:
            rank, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= len(ids) or ids[i] is None or ids[i] << 20 | ids[j] != pair:
                continue
            ids[i], ids[j] = rank & 0xFFFFF, None
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (p := ids[left] << 20 | ids[right]) in self.rank:
                    heapq.heappush(queue, (self.rank[p], left, p))
        return [i for i in ids if i is not None]

    def word(self, word: str) -> list[int]:
        *parts, last = self.fragments_of(word.encode())
        if not parts:
            return self.fragment((last, True))
        return [i for p in parts for i in self.fragments[p, False]] + self.fragments[last, True]

    def piece(self, piece: str) -> bytes:
        """Ids of text without white space, as little-endian 32-bit integers."""
        if piece.isascii():
            text = piece.lower()
        else:
            text = unicodedata.normalize("NFC", piece)
            # character by character: str.lower has another form for a sigma at the end of a word
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := [i for w in self.split.findall(text) for i in self.words[w]]) else b""

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; special tokens in it count as such."""
        if self.at_special and self.at_special.search(text):
            parts = self.at_special.split(text)
            return b"".join(
                np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts) if p
            )
        pieces = re.split(f"[{WHITE}]+", text) if ONLY_PYTHON_WHITE.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        return decoded(self.tokens, ids)


def token_list(spec: dict) -> list[str]:
    """Token by id, those of the vocabulary and the special ones."""
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = token
    return tokens


def decoded(tokens: list[str], ids: bytes) -> str:
    """The tokens with a space between them, as a tokenizer without a decoder joins them."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Memory(dict):
    """Results of a function in two generations: when the young one holds its bytes it becomes the old one, which is looked up on a miss."""

    def __init__(self, function, most: int = MEMORY_BYTES):
        self.function, self.most, self.held, self.old = function, most, 0, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.function(key)
        # a fragment is named with whether it ends its word, and has its ids as a list
        n = len(key) if isinstance(key, str) else len(key[0])
        if n <= LONG:
            if self.held >= self.most:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + 2 * n + (len(value) if isinstance(value, bytes) else 8 * len(value) + 80)
            self[key] = value
        return value


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def tokens_of(path: str) -> list[str]:
    """All that decoding needs of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return token_list(json.load(f))


def encode(docs: DataFrame, path: str, *carry: str, decode: bool = False) -> DataFrame:
    """The columns ``carry`` with ids (binary, little-endian unsigned 32-bit) and n_tokens of every whole text.

    With ``decode`` also ``decoded``, the text that the ids give back, from the same worker. Null counts as empty, which has
    no ids. Repeated rows get equal ids; an empty table gives an empty result. ``path`` names a tokenizer file that every
    executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in slices(batch):
                ids = [known.encode(t or "") for t in part.column("text").to_pylist()]
                found = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decode:
                    found.append(pa.array([known.decode(x) for x in ids], pa.string()))
                yield pa.record_batch([*(part.column(c) for c in names), *found], names=[*names, *added])

    columns, kinds, names = carried(docs, carry)
    added = ["ids", "n_tokens", "decoded"] if decode else ["ids", "n_tokens"]
    schema = kinds + "ids binary, n_tokens long" + (", decoded string" if decode else "")
    return docs.select("text", *columns).mapInArrow(run, schema).withColumnsRenamed(names)


def decode(encoded: DataFrame, path: str, *carry: str) -> DataFrame:
    """The columns ``carry`` with ``decoded``, the text of the column ``ids``; null ids are none. Only the list of tokens is loaded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [decoded(tokens, x or b"") for x in part.column("ids").to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    columns, kinds, names = carried(encoded, carry)
    return encoded.select("ids", *columns).mapInArrow(run, kinds + "decoded string").withColumnsRenamed(names)
