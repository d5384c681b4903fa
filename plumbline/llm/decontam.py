"""Benchmark decontamination with SimHash windows.

Every benchmark item has a fingerprint of its word shingles. Windows of a document that are as long as
an item and hold at least one of the item's shingles (all others have similarity 0) get fingerprints from running
sums. A multi-index over blocks of the fingerprint finds every item within RADIUS bits, and weighted
shingle similarity of window and item decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried
from plumbline.llm.wordhash import WordHashes, shingles

WORDS = 5
LEAST = 0.8
BITS = 64
RADIUS = 26  # windows of similarity 0.8 differ in 10 bits on average, in more than 26 with probability 1e-7
BLOCKS = 8
BLOCK_BITS = BITS // BLOCKS
BLOCK_BYTES = 8 << 20  # benchmark text that one pass over the documents is given
OTHER_PUNCTUATION = re.compile(r"[^\w\x00-\x7f]+")
FILTER_BITS = 20


# ASCII that is no letter, digit or underscore ends a word; so does other punctuation, replaced by a space before
_WORDS = WordHashes(bytes(b for b in range(128) if not (chr(b).isalnum() or b == ord("_"))))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, lower-cased, without punctuation."""
    if not text.isascii():
        text = OTHER_PUNCTUATION.sub(" ", text).lower()
    return _WORDS(text.encode("utf-8", "surrogatepass"))


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for the bits of each hash."""
    return (np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) << 1) - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of BLOCKS bytes, of rows of bit sums."""
    return np.packbits(sums > 0, axis=1)


NEAR = np.array([[bin(a ^ b).count("1") <= RADIUS // BLOCKS for b in range(1 << BLOCK_BITS)] for a in range(1 << BLOCK_BITS)])
POPCOUNT = np.array([bin(a).count("1") for a in range(256)], np.uint8)


class Items:
    """Benchmark items by length, their shingles and the multi-index of their fingerprints."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.names, self.counts, self.lengths, prints = [], [], [], []
        holders = defaultdict(set)
        for name, text in rows:
            words = word_hashes(text)
            if not len(words):
                continue
            span = min(WORDS, len(words))
            h = shingles(words, span)
            for x in h.tolist():
                holders[span, x].add(len(self.names))
            self.names.append(name)
            self.counts.append(Counter(h.tolist()))
            self.lengths.append(len(words))
            prints.append(packed(signs(h).sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, BLOCKS)
        self.spans = sorted({s for s, _ in holders})
        self.known = {s: np.sort(np.array([x for t, x in holders if t == s], np.uint64)) for s in self.spans}
        self.holders = {k: sorted(v) for k, v in holders.items()}
        self.maybe = {}
        for s, known in self.known.items():
            self.maybe[s] = np.zeros(1 << FILTER_BITS, bool)
            self.maybe[s][(known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        # block k of a fingerprint -> items whose block k is near: two fingerprints within RADIUS agree so in one block at least
        self.index = [NEAR[self.prints[:, k]].T if len(self.names) else None for k in range(BLOCKS)]

    def hits(self, h: np.ndarray, span: int) -> np.ndarray:
        """Places whose shingle is one of the benchmark's."""
        at = np.flatnonzero(self.maybe[span][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at):
            return at
        known = self.known[span]
        place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        return at[known[place] == h[at]]

    def found(self, text: str, least: float) -> dict[int, float]:
        """Items that a window of the text resembles, with the best similarity."""
        words, out = word_hashes(text), {}
        for span in self.spans:
            h = shingles(words, span)
            if not len(h):
                continue
            at = self.hits(h, span)
            by_item = defaultdict(list)
            for p in at.tolist():
                for item in self.holders[span, int(h[p])]:
                    by_item[item].append(p)
            by_length = defaultdict(set)
            for item, places in by_item.items():
                wide = self.lengths[item] - span + 1
                for p in places:
                    by_length[wide].update(range(max(0, p - wide + 1), min(p, len(h) - 1) + 1))
            for wide, starts in by_length.items():
                self._windows(h, span, wide, sorted(starts), least, out)
        return out

    def _windows(self, h: np.ndarray, span: int, wide: int, starts: list[int], least: float, out: dict[int, float]) -> None:
        begin = np.array(starts)
        for run in np.split(begin, np.flatnonzero(np.diff(begin) > wide) + 1):
            for at in range(0, len(run), 4096):
                part = run[at : at + 4096]
                low, high = int(part[0]), min(int(part[-1]) + wide, len(h))
                sums = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(signs(h[low:high]), axis=0, dtype=np.int32)])
                ends = np.minimum(part + wide, len(h)) - low
                prints = packed(sums[ends] - sums[part - low])
                near = reduce(np.logical_or, (self.index[k][prints[:, k]] for k in range(BLOCKS)))
                same = np.array([n - span + 1 == wide and min(WORDS, n) == span for n in self.lengths])
                for w, item in np.argwhere(near & same).tolist():
                    if POPCOUNT[prints[w] ^ self.prints[item]].sum() <= RADIUS:
                        s = self.similarity(h[int(part[w]) : int(part[w]) + wide], item)
                        if s >= least and s > out.get(item, 0):
                            out[item] = s

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard: a shingle weighs as often as it occurs."""
        mine, theirs = Counter(window.tolist()), self.counts[item]
        shared = sum((mine & theirs).values())
        return shared / (mine.total() + theirs.total() - shared)


def benchmark_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in hash blocks of about ``most`` bytes: its size is checked, never assumed."""
    rows = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("none")).alias("item"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // most))
    for b in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, *carry: str, least: float = LEAST) -> DataFrame:
    """The columns ``carry`` of the documents that hold a benchmark passage, with ``items`` (names of the items) and ``best_similarity``.

    A passage is a window of as many words as the item with a weighted similarity of shingles of five words of ``least`` or
    more; an item of fewer words is one shingle. Words are runs of letters, digits and underscores; case does not count. Documents without
    a passage, null and empty texts are not in the result. Null items count for nothing; items with the same id and other texts are items
    of their own under one name. Repeated rows are all in the result; an empty table or benchmark gives an empty result.
    """
    columns, kinds, names = carried(docs, carry)
    rows, parts = docs.select("text", *columns), []
    for block in benchmark_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block)
            for batch in batches:
                found = {i: f for i, t in enumerate(batch.column("text").to_pylist()) if t and (f := items.found(t, least))}
                if found:
                    chosen = batch.take(pa.array(list(found)))
                    met = [sorted({items.names[x] for x in f}) for f in found.values()]
                    yield pa.record_batch(
                        [*(chosen.column(c) for c in names), pa.array(met, pa.list_(pa.string())),
                         pa.array([max(f.values()) for f in found.values()], pa.float64())], names=[*names, "items", "best_similarity"])

        if block or not parts:
            parts.append(rows.mapInArrow(run, kinds + "items array<string>, best_similarity double"))
    return reduce(DataFrame.unionAll, parts).withColumnsRenamed(names)
