"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Both tokenizers cut the same bytes. Where both end a token the text falls into groups; a token of one side is
linked with every token of the other whose bytes it overlaps. How many documents hold a pair of ids linked is counted outside
memory: workers cut their pair-document records by a radix of the A id into runs, sorted by A id, B id and document and packed
with zstandard. A task of a radix merges its runs with a heap and counts each pair; runs of a large radix go over several such tasks,
whose counts are added. Reading the counts side by side, one A id after the other, gives each id's highest, and the runs,
streamed a second time, send every document its share.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import byte_characters
from plumbline.llm.common import Scratch, carried, slices

RADIX = 64  # radix partitions of the A ids
BLOCK_BYTES = 6 << 20  # of the texts whose records make one run for each radix
RUN_BYTES = 48 << 20  # of the packed runs that one merging task reads
CHUNK = 4096  # pairs of a run that are unpacked at a time
LONG = 1 << 18  # code points; longer texts go through the tokenizers library, whose ids are the same
LEVEL = 3


class ByteLevel:
    """Side A: a byte-level BPE file; ids of a text, bytes of an id. Special tokens in a text are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("this kind of tokenizer file is not supported")
        code = {c: b for b, c in byte_characters().items()}
        special = {t["id"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in model["vocab"].items() if i not in special}
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges do not follow the ids")
        ranks = {bytes(code[c] for c in t): i for t, i in ids.items()}
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("a byte has no token")  # with all of them every text comes back byte by byte
        # merges in the order of the ids: the same tokens as the file's, several times faster
        self.quick = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = path

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG:
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.quick.encode_ordinary(text), np.int64)


# fixed value: the pattern of byte-level pre-tokenizers, as the library has it built in
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def library(path: str):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True
    known.no_truncation()
    known.no_padding()
    return known


class Pieces:
    """Side B: a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self.piece_bytes(i) for i in range(self.model.get_piece_size())]

    def piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()


class Aligner:
    """Both sides and what the work on a block of texts looks up."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_len, self.b_len = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        ids_a, ids_b = ([str(i) for i in range(len(side.bytes))] for side in (self.a, self.b))
        self.words = [i + end for ids, ends in ((ids_a, ",|"), (ids_b, ",;")) for end in ends for i in ids]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if the text is empty or one side's bytes are not those of a space and the text."""
        if text:
            data, pieces = (" " + text).encode(), self.b.model.encode(text)
            if b"".join(map(self.b.bytes.__getitem__, pieces)) == data:
                return self.a.encode(" " + text), np.array(pieces, np.int64)
        return NONE, NONE

    def block(self, texts: list[str | None]) -> Block:
        return Block(self, texts)


NONE = np.zeros(0, np.int64)


class Block:
    """Groups, links and pair-document records of some texts."""

    def __init__(self, known: Aligner, texts: list[str | None]):
        found = [known.tokens(t) for t in texts]
        self.n_a, self.n_b = (np.array([len(x[side]) for x in found], np.int64) for side in (0, 1))
        a, b = (np.concatenate([NONE, *(x[side] for x in found)]) for side in (0, 1))
        # all texts on one line of bytes: place p is marked where a token ends before byte p
        a_ends, b_ends = np.cumsum(known.a_len[a]), np.cumsum(known.b_len[b])
        last = int(a_ends[-1]) if len(a_ends) else 0
        at_a, at_b = np.zeros(last + 1, bool), np.zeros(last + 1, bool)
        at_a[a_ends], at_b[b_ends] = True, True
        past_a, past_b = np.cumsum(at_a), np.cumsum(at_b)  # tokens that end at or before a place
        doc_ends = np.append(0, a_ends)[np.cumsum(self.n_a)]
        # a stretch between two marks lies in one token of each side: the stretches are the links
        marks, common = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
        doc = np.searchsorted(doc_ends, marks)
        self.n_links = np.bincount(doc, minlength=len(texts))
        self.n_groups = np.bincount(np.searchsorted(doc_ends, common), minlength=len(texts))
        self.link_a, self.link_b = a[past_a[marks] - at_a[marks]], b[past_b[marks] - at_b[marks]]
        self.link_doc = doc
        # groups one after the other, in each the tokens of A and then those of B
        both = np.cumsum(at_a & at_b)
        before_b = np.append(0, past_b[common])[both[a_ends] - at_b[a_ends]] if len(a) else NONE
        before_a = past_a[common][both[b_ends] - at_a[b_ends]] if len(b) else NONE
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b] = a + len(known.a_len) * at_b[a_ends]
        order[np.arange(len(b)) + before_a] = 2 * len(known.a_len) + b + len(known.b_len) * at_a[b_ends]
        self.order, self.words = order, known.words

    def groups(self) -> Iterator[str]:
        """Of every text its groups, as ``a1,a2|b1;a3|b2,b3``."""
        start = 0
        for n in (self.n_a + self.n_b).tolist():
            yield "".join(map(self.words.__getitem__, self.order[start : start + n].tolist()))[:-1]
            start += n

    def records(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair (A id in the high half), text and number of links, once for each pair of a text, sorted."""
        if not len(self.link_a):
            return NONE, NONE, NONE
        pairs, pair_no = np.unique(self.link_a << 32 | self.link_b, return_inverse=True)
        texts = len(self.n_a)
        held, times = np.unique(pair_no * texts + self.link_doc, return_counts=True)
        return pairs[held // texts], held % texts, times

    def runs(self, radix: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Radix, packed pairs with their counts, packed texts with their links."""
        pair, text, times = self.records()
        part = (pair >> 32) % radix
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(radix + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            these = order[bounds[r] : bounds[r + 1]]
            pairs, counts = np.unique(pair[these], return_counts=True)
            head = [packed(np.diff(pairs[i : i + CHUNK], prepend=0), counts[i : i + CHUNK]) for i in range(0, len(pairs), CHUNK)]
            yield r, b"".join(struct.pack("<I", len(x)) + x for x in head), packed(text[these], times[these])


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length with the like bytes of their numbers side by side, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<i8").reshape(-1) for p in planes]


def chunks(head: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and their counts, one chunk of a run at a time."""
    at = 0
    while at < len(head):
        (n,) = struct.unpack_from("<I", head, at)
        gaps, counts = unpacked(head[at + 4 : at + 4 + n], 2)
        yield np.cumsum(gaps), counts
        at += 4 + n


def merged_counts(heads: list[bytes]) -> Iterator[tuple[int, int]]:
    """Every pair of the runs with its number of documents, in side-major order: a heap holds the next pair of each run."""

    def pairs(head: bytes) -> Iterator[tuple[int, int]]:
        for pair, counts in chunks(head):
            yield from zip(pair.tolist(), counts.tolist())

    for pair, same in groupby(heapq.merge(*map(pairs, heads)), itemgetter(0)):
        yield pair, sum(n for _, n in same)


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


DOC_FIELDS = {"ordinal": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string()}
RUN_FIELDS = {"radix": pa.int32(), "packed_bytes": pa.int64(), "head": pa.binary(), "body": pa.binary()}


def spilled(docs: DataFrame, a_path: str, b_path: str, columns: list, kinds: str, names: list[str], radix: int, block_bytes: int, digest: bool) -> DataFrame:
    """One row for every document (kind 0) and for every run of a block (kind 1); ``block`` names the block of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part, count = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for texts in slices(batch, most=block_bytes):
                name, count = part << 32 | count, count + 1
                block = known.block(texts.column("text").to_pylist())
                groups = [hashlib.sha256(g.encode()).hexdigest() if digest and g else g for g in block.groups()]
                found = [np.arange(texts.num_rows), block.n_a, block.n_b, block.n_groups, block.n_links, groups]
                runs = list(zip(*((r, len(h) + len(b), h, b) for r, h, b in block.runs(radix)))) or [[]] * 4
                for kind, rows, mine in (
                    (0, texts.num_rows, {n: texts.column(n) for n in names} | {n: pa.array(v, t) for (n, t), v in zip(DOC_FIELDS.items(), found)}),
                    (1, len(runs[0]), {n: pa.array(v, t) for (n, t), v in zip(RUN_FIELDS.items(), runs)}),
                ):
                    if rows:
                        fixed = {"kind": pa.array([kind] * rows, pa.int32()), "block": pa.array([name] * rows, pa.int64())}
                        all_of = {n: texts.schema.field(n).type for n in names} | DOC_FIELDS | RUN_FIELDS
                        yield pa.record_batch(fixed | {n: mine[n] if n in mine else pa.nulls(rows, t) for n, t in all_of.items()})

    schema = (
        f"kind int, block long, {kinds}ordinal long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "radix int, packed_bytes long, head binary, body binary"
    )
    return docs.select(*columns, "text").mapInArrow(run, schema)


def count_runs(table: pa.Table) -> pa.Table:
    found = list(merged_counts(table.column("head").to_pylist()))
    pair, n = (np.array(x, np.int64) for x in zip(*found)) if found else (NONE, NONE)
    return pa.table({"a": pa.array(pair >> 32, pa.int32()), "b": pa.array(pair & 0xFFFFFFFF, pa.int32()), "n": pa.array(n, pa.int64())})


def shares(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the pairs of these runs give to each of their documents: sum of counts over links, and links whose count is their A id's highest."""
    pair = counts.column("a").to_numpy().astype(np.int64) << 32 | counts.column("b").to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], counts.column("n").to_numpy()[order]
    starts = np.flatnonzero(np.diff(pair >> 32, prepend=-1)) if len(pair) else NONE
    best = np.repeat(np.maximum.reduceat(n, starts), np.diff(starts, append=len(pair))) == n if len(pair) else np.zeros(0, bool)
    out = []
    for block, head, body in zip(*(runs.column(c).to_pylist() for c in ("block", "head", "body"))):
        text, times = unpacked(body, 2)
        sums, bests, at = np.zeros(text.max() + 1, np.int64), np.zeros(text.max() + 1, np.int64), 0
        for pairs, counted in chunks(head):
            stop, place = at + int(counted.sum()), np.repeat(np.searchsorted(pair, pairs), counted)
            np.add.at(sums, text[at:stop], n[place] * times[at:stop])
            np.add.at(bests, text[at:stop], best[place] * times[at:stop])
            at = stop
        some = np.flatnonzero(sums)
        out.append((np.full(len(some), block), some, sums[some], bests[some]))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [NONE] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["block", "ordinal", "count_sum", "n_best"])


def cross_align(
    docs: DataFrame, a_path: str, b_path: str, *carry: str, radix: int = RADIX, run_bytes: int = RUN_BYTES, block_bytes: int = BLOCK_BYTES, digest: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the pair counts (a, b, n: documents that hold the pair linked).

    The first has the columns ``carry`` with n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups`` (``a1,a2|b1;a3|b2,b3``, or
    with ``digest`` its lower-case hex SHA-256). A null or empty text has no tokens, nor has one that a side does not give back byte by
    byte: zeros and empty groups. Rows that repeat are documents of their own, in the counts too. Whole texts are read. An
    empty table gives empty results. Blocks, runs and the share of a radix that one task merges are bounded by
    bytes, so a frequent id or group of copies only makes more of them.
    """
    columns, kinds, names = carried(docs, carry)
    scratch = Scratch(docs.sparkSession, "crosstok")
    kept = scratch.keep(spilled(docs, a_path, b_path, columns, kinds, list(names), radix, block_bytes, digest), "kind")
    runs = kept.where("kind = 1").select("block", "radix", "packed_bytes", "head", "body")
    # at most ``radix`` rows
    splits = runs.groupBy("radix").agg(F.ceil(F.sum("packed_bytes") / run_bytes).cast("int").alias("splits"))
    runs = runs.join(F.broadcast(splits), "radix").withColumn("split", F.pmod(F.xxhash64("block"), "splits").cast("int"))
    counted = runs.select("radix", "split", "head").groupBy("radix", "split").applyInArrow(count_runs, "a int, b int, n long")
    counts = scratch.keep(counted.groupBy("a", "b").agg(F.sum("n").alias("n")))
    with_radix = counts.withColumn("radix", F.pmod("a", F.lit(radix))).join(F.broadcast(splits), "radix")
    with_radix = with_radix.select("a", "b", "n", "radix", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    given = (
        runs.select("radix", "split", "block", "head", "body").groupBy("radix", "split").cogroup(with_radix.groupBy("radix", "split"))
        .applyInArrow(shares, "block long, ordinal long, count_sum long, n_best long")
    )
    totals = given.groupBy("block", "ordinal").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    found = kept.where("kind = 0").join(totals, ["block", "ordinal"], "left").select(*names, "n_a", "n_b", "n_groups", "n_links", *sums, "groups")
    return found.withColumnsRenamed(names), counts
