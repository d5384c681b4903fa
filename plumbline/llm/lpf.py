"""Repeated passages by longest previous factors over a sparse suffix order.

A byte is removed when a 50-byte string over it also starts in an earlier document: when the longest
previous factor of some position is 50 or more. Suffixes are sampled so that equal 50-byte strings sample the same place: the
smallest PREFIX-byte hash in each string. Sampled suffixes are put in order by fingerprints of growing prefixes, and in each run of equal
ones the previous smaller position says whether an earlier document has it:

1. PREFIX bytes: suffixes that nobody shares drop out;
2. the whole context that any 50-byte string around the sample can reach: equal to an earlier one, all strings around it are repeated;
3. single 50-byte strings, for contexts that agree in part: the edges of repeated passages.

Documents are kept in slices in doc_id order, so a smaller slice is an earlier one and only fingerprints travel. A slice sends a
fingerprint once, however many of its documents have it, so a passage in a third of all documents is one entry per slice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, bytes_of
from plumbline.llm.wordhash import RADIX, _powers, mixed

LENGTH = 50
PREFIX = 24
REACH = LENGTH - PREFIX  # bytes before a sample that a string over it can begin
SLICE = 1 << 20  # bytes of text in a slice; a longer document, or one id's rows, make a longer slice
SEGMENT = 1 << 18  # string starts looked at together
BUCKET_BYTES = 8 << 20  # text for each bucket of fingerprints
MARGIN = 2 * LENGTH

PACKED = "part int, slice long, ids array<long>, ranks array<int>, sizes array<long>, digests array<binary>, body binary"
LOW48 = np.uint64((1 << 48) - 1)


def _packer(slice_bytes: int):
    """Rows in doc_id order to slices; ``ranks`` number the different ids of a slice."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        count, held, rows = 0, 0, []

        def row() -> pa.RecordBatch:
            ids, ranks, texts = [r[0] for r in rows], [], [r[1] for r in rows]
            for i, x in enumerate(ids):
                ranks.append(0 if not i else ranks[-1] + (x != ids[i - 1]))
            digests = [hashlib.sha256(t).digest() for t in texts]
            values = [[part], [(part << 32) + count], [ids], [ranks], [list(map(len, texts))], [digests], [b"".join(texts)]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text"))):
                if rows and held + len(text) > slice_bytes and doc_id != rows[-1][0]:
                    yield row()
                    count, held, rows = count + 1, 0, []
                rows.append((doc_id, text))
                held += len(text)
        if rows:
            yield row()

    return pack


_VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(RADIX))
_POWER = _powers(RADIX, SEGMENT + 4 * MARGIN)
_INVERSE = _powers(pow(RADIX, -1, 1 << 64), SEGMENT + 4 * MARGIN)


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    choose, span = np.minimum if least else np.maximum, 1
    while span * 2 <= width:
        values = choose(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return choose(values[:-rest], values[rest:]) if rest else values


class Segment:
    """Strings that begin in one stretch of a slice, their samples and fingerprints.

    ``windows`` are starts of 50-byte strings inside one document, ``at`` the sampled places, all relative to
    ``base``; ``key`` is the 48-bit prefix fingerprint of each sample.
    """

    def __init__(self, body: np.ndarray, ends: np.ndarray, skip: np.ndarray, start: int, stop: int):
        self.base = max(0, start - MARGIN)
        a = body[self.base : stop + 2 * MARGIN]
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_VALUE[a] * _POWER[: len(a)], out=self.sums[1:])
        n = len(a) - LENGTH + 1
        self.at = self.doc = self.starts = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n <= 0:
            return
        # the document of each start; a string that leaves it, or is out of the stretch, is none
        first = np.searchsorted(ends, self.base, "right")
        inner = ends[first : np.searchsorted(ends, self.base + len(a), "left")] - self.base
        self.bounds, self.first_doc = np.r_[0, inner, len(a)], first
        valid = np.zeros(n, bool)
        valid[start - self.base : stop - self.base] = True
        for e in inner.tolist():
            valid[max(0, e - LENGTH + 1) : e] = False
        for d in np.flatnonzero(skip[first : first + len(inner) + 1]).tolist():
            valid[self.bounds[d] : self.bounds[d + 1]] = False
        if not valid.any():
            return
        gram = (self.sums[PREFIX:] - self.sums[:-PREFIX]) * _INVERSE[: len(a) - PREFIX + 1]
        full = mixed(gram)
        short = (full >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = _slide(short, REACH + 1, True)
        low[~valid[: len(low)]] = 0
        pad = np.zeros(REACH, np.uint32)
        high = _slide(np.concatenate([pad, low, pad]), REACH + 1, False)
        self.low, self.short, self.valid = low, short, valid
        self.at = np.flatnonzero(short == high)
        self.key = full[self.at]
        self.doc = np.searchsorted(self.bounds, self.at, "right") - 1

    def context(self, which: np.ndarray) -> np.ndarray:
        """Fingerprints of everything that strings over the samples reach in their documents."""
        at, doc = self.at[which], self.doc[which]
        low = np.maximum(at - REACH, self.bounds[doc])
        high = np.minimum(at + LENGTH, self.bounds[doc + 1])
        value = mixed((self.sums[high] - self.sums[low]) * _INVERSE[low])
        return mixed(value + (at - low).astype(np.uint64) * np.uint64(LENGTH) + (high - at).astype(np.uint64))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sample, start) of the strings whose sample one of ``which`` is."""
        at = self.at[which]
        starts = at[:, None] - np.arange(REACH, -1, -1)
        inside = (starts >= 0) & (starts < len(self.low))
        chosen = inside & (self.low[np.where(inside, starts, 0)] == self.short[at][:, None])
        rows, columns = np.nonzero(chosen)
        return which[rows], starts[rows, columns]

    def string_hash(self, starts: np.ndarray) -> np.ndarray:
        return mixed((self.sums[starts + LENGTH] - self.sums[starts]) * _INVERSE[starts])


def _segments(row: dict, skip: np.ndarray) -> Iterator[Segment]:
    body = np.frombuffer(row["body"], np.uint8)
    ends = np.cumsum(row["sizes"])
    for start in range(0, len(body) - LENGTH + 1, SEGMENT):
        yield Segment(body, ends, skip, start, min(start + SEGMENT, len(body) - LENGTH + 1))


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys & LOW48).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _smaller_rank(keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Whether an equal key has a smaller rank: in the order of (key, rank) the start of the run is the previous smaller position."""
    order = np.lexsort((ranks, keys))
    k, r = keys[order], ranks[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    least = r[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else r
    out = np.zeros(len(keys), bool)
    out[order] = least < r
    return out


class Verdicts:
    """Small results for each slice in the shared folder, a file per part, read where the slice is worked on."""

    def __init__(self, path: str):
        self.path, self.part, self.rows = path, None, {}

    def of(self, part: int, slice_id: int) -> dict[str, bytes]:
        if part != self.part:
            system, folder = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", f"{self.path}/part={part}"))
            self.part, self.rows = part, {}
            if system.get_file_info(folder).type == pa.fs.FileType.Directory:
                for info in system.get_file_info(pa.fs.FileSelector(folder)):
                    if info.base_name.startswith("part-"):
                        for r in pa.parquet.read_table(info.path, filesystem=system, partitioning=None).to_pylist():
                            kept = self.rows.setdefault(r.pop("slice"), {})
                            for k, v in r.items():
                                kept[k] = kept.get(k, b"") + (v or b"")
        return self.rows.get(slice_id, {})


def _keep_verdicts(scratch: Scratch, df: DataFrame) -> str:
    scratch.keep(df.repartition("part"), "part")
    return f"{scratch.path}/{scratch.count - 1}"


def _skips(row: dict, verdict: dict[str, bytes]) -> np.ndarray:
    skip = np.zeros(len(row["sizes"]), bool)
    skip[np.frombuffer(verdict.get("copies", b""), np.int32)] = True
    return skip


def _by_bucket(buckets: int, row: dict, keys: np.ndarray, **columns: Callable[[np.ndarray], bytes]) -> Iterator[dict]:
    """Rows of a slice for each bucket; ``columns`` make their bytes from places in ``keys``."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        which = order[i:j]
        yield {"bucket": int(bucket[which[0]]), "part": row["part"], "slice": row["slice"], **{n: f(which) for n, f in columns.items()}}


SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("slice", pa.int64()), ("first", pa.binary()), ("second", pa.binary())])
SENT_TYPE = "bucket int, part int, slice long, first binary, second binary"
BACK = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("first", pa.binary()), ("second", pa.binary())])
BACK_TYPE = "part int, slice long, first binary, second binary"


def _over_slices(work: Callable[[dict], Iterator[dict]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(work(batch.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                pa.default_memory_pool().release_unused()

    return run


def _prefixes(copies: str, buckets: int):
    """1: fingerprints of a slice's samples, with those that several of its documents have."""
    known = Verdicts(copies)

    def work(row: dict) -> Iterator[dict]:
        keys, ranks = [], []
        for s in _segments(row, _skips(row, known.of(row["part"], row["slice"]))):
            keys.append(s.key)
            ranks.append(np.array(row["ranks"], np.int32)[s.doc + s.first_doc] if len(s.doc) else np.zeros(0, np.int32))
        if keys:
            key, rank = np.concatenate(keys), np.concatenate(ranks)
            order = np.lexsort((rank, key))
            key, rank = key[order], rank[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            several = rank[np.r_[new[1:], len(key)] - 1] != rank[new] if len(key) else np.zeros(0, bool)
            unique = key[new]
            yield from _by_bucket(buckets, row, unique, first=lambda w: _short(unique[w]), second=lambda w: np.packbits(several[w]).tobytes())

    return _over_slices(work, SENT)


def _meet(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Fingerprints of all slices of a bucket, the number of the slice's row for each, and the rows in slice order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
    keys = np.concatenate([_long(r["first"]) if width == 6 else np.frombuffer(r["first"], np.uint64) for r in rows])
    return keys, np.repeat(np.arange(len(rows)), [len(r["first"]) // width for r in rows]), rows


def _answers(rows: list[dict], owner: np.ndarray, **columns: tuple[np.ndarray, Callable[[np.ndarray], bytes]]) -> pa.Table:
    """For each slice the chosen entries of each column as bytes."""
    out = []
    begin = np.searchsorted(owner, np.arange(len(rows) + 1))
    for i, r in enumerate(rows):
        found = {n: f(begin[i] + np.flatnonzero(chosen[begin[i] : begin[i + 1]])) for n, (chosen, f) in columns.items()}
        if any(found.values()):
            out.append({"part": r["part"], "slice": r["slice"], **found})
    return pa.Table.from_pylist(out, schema=BACK)


def _shared(table: pa.Table) -> pa.Table:
    keys, owner, rows = _meet(table, 6)
    several = np.concatenate([np.unpackbits(np.frombuffer(r["second"], np.uint8), count=len(r["first"]) // 6).astype(bool) for r in rows])
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    run = np.cumsum(new) - 1
    met = (np.bincount(run) > 1) | np.bincount(run, weights=several[order]).astype(bool)
    chosen = np.zeros(len(keys), bool)
    chosen[order] = met[run]
    return _answers(rows, owner, first=(chosen, lambda w: _short(keys[w])), second=(np.zeros(len(keys), bool), lambda w: b""))


def _pairs(keys: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """One 64-bit name for a prefix and a context."""
    return mixed((keys & LOW48) * np.uint64(RADIX) + contexts)


def _context_samples(row: dict, skip: np.ndarray, shared: bytes) -> Iterator[tuple[Segment, np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, samples with a shared prefix, their context fingerprints, ranks of their documents)"""
    known, ranks = np.sort(_long(shared)), np.array(row["ranks"], np.int64)
    for s in _segments(row, skip):
        which = np.flatnonzero(_in(s.key & LOW48, known))
        if len(which):
            yield s, which, s.context(which), ranks[s.doc[which] + s.first_doc]


def _contexts(copies: str, shared: str, buckets: int):
    """2: (prefix, context) of the samples with a shared prefix."""
    skips, shares = Verdicts(copies), Verdicts(shared)

    def work(row: dict) -> Iterator[dict]:
        at = row["part"], row["slice"]
        found = [(s.key[w], c) for s, w, c, _ in _context_samples(row, _skips(row, skips.of(*at)), shares.of(*at).get("first", b""))]
        if found:
            key, context = (np.concatenate(x) for x in zip(*found))
            _, first = np.unique(_pairs(key, context), return_index=True)
            key, context = key[first], context[first]
            yield from _by_bucket(buckets, row, key, first=lambda w: _short(key[w]), second=lambda w: context[w].tobytes())

    return _over_slices(work, SENT)


def _ordered(table: pa.Table) -> pa.Table:
    """first: contexts that an earlier slice has. second: first occurrences of contexts whose prefix has others too."""
    keys, owner, rows = _meet(table, 6)
    contexts = np.concatenate([np.frombuffer(r["second"], np.uint64) for r in rows])
    pairs = _pairs(keys, contexts)
    later = _smaller_rank(pairs, owner)
    order = np.lexsort((pairs, keys))
    k, p = keys[order], pairs[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    run = np.cumsum(new_key) - 1
    kinds = np.bincount(run, weights=new_key | np.r_[True, p[1:] != p[:-1]])
    mixed_run = np.zeros(len(keys), bool)
    mixed_run[order] = (kinds > 1)[run]
    name = lambda w: pairs[w].tobytes()
    return _answers(rows, owner, first=(later, name), second=(~later & mixed_run, name))


def _edge_strings(row: dict, skip: np.ndarray, shared: bytes, levels: dict[str, bytes]):
    """For each segment: (segment, starts repeated by their context, starts to be compared singly, ranks of these)."""
    later = np.sort(np.frombuffer(levels.get("first", b""), np.uint64))
    partly = np.sort(np.frombuffer(levels.get("second", b""), np.uint64))
    found = list(_context_samples(row, skip, shared))
    if not found:
        return
    pairs = [_pairs(s.key[w], c) for s, w, c, _ in found]
    in_slice = _smaller_rank(np.concatenate(pairs), np.concatenate([r for *_, r in found]))
    begin = 0
    for (s, which, _, ranks), pair in zip(found, pairs):
        repeated = in_slice[begin : begin + len(pair)] | _in(pair, later)
        begin += len(pair)
        single = ~repeated & _in(pair, partly)
        _, whole = s.strings(which[repeated])
        sample, starts = s.strings(which[single])
        rank_of = np.zeros(len(s.at), np.int64)
        rank_of[which] = ranks
        yield s, whole, starts, rank_of[sample]


def _strings(copies: str, shared: str, levels: str, buckets: int):
    """3: fingerprints of the single strings to be compared."""
    skips, shares, known = Verdicts(copies), Verdicts(shared), Verdicts(levels)

    def work(row: dict) -> Iterator[dict]:
        at = row["part"], row["slice"]
        found = [s.string_hash(starts) for s, _, starts, _ in _edge_strings(row, _skips(row, skips.of(*at)), shares.of(*at).get("first", b""), known.of(*at))]
        if found:
            unique = np.unique(np.concatenate(found))
            yield from _by_bucket(buckets, row, unique, first=lambda w: unique[w].tobytes(), second=lambda w: b"")

    return _over_slices(work, SENT)


def _repeated(table: pa.Table) -> pa.Table:
    keys, owner, rows = _meet(table, 8)
    none = np.zeros(len(keys), bool)
    return _answers(rows, owner, first=(_smaller_rank(keys, owner), lambda w: keys[w].tobytes()), second=(none, lambda w: b""))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(copies: str, shared: str, levels: str, repeated: str):
    """The documents of a slice without their repeated bytes."""
    stores = [Verdicts(p) for p in (copies, shared, levels, repeated)]

    def work(row: dict) -> Iterator[dict]:
        skips, shares, known, again = (s.of(row["part"], row["slice"]) for s in stores)
        skip, body = _skips(row, skips), row["body"]
        edges = list(_edge_strings(row, skip, shares.get("first", b""), known))
        later = np.sort(np.frombuffer(again.get("first", b""), np.uint64))
        hashes = [s.string_hash(starts) for s, _, starts, _ in edges]
        in_slice = _smaller_rank(np.concatenate(hashes), np.concatenate([r for *_, r in edges])) if edges else None
        change, begin = np.zeros(len(body) + 1, np.int32), 0
        for (s, whole, starts, _), h in zip(edges, hashes):
            gone = in_slice[begin : begin + len(h)] | _in(h, later)
            begin += len(h)
            at = np.unique(np.r_[whole, starts[gone]]) + s.base
            np.add.at(change, at, 1)
            np.add.at(change, at + LENGTH, -1)
        removed = np.cumsum(change[:-1]) > 0
        start = 0
        for i, (doc_id, size) in enumerate(zip(row["ids"], row["sizes"])):
            mask = removed[start : start + size]
            if skip[i]:
                mask = np.ones(size, bool)
            text = np.frombuffer(body, np.uint8)[start : start + size]
            spans = int((mask & ~np.r_[False, mask[:-1]]).sum()) if size else 0
            yield {"doc_id": doc_id, "n_bytes": size, "n_removed": int(mask.sum()), "n_spans": spans, "kept": text[~mask].tobytes()}
            start += size

    return _over_slices(work, RESULT)


def _copies(packed: DataFrame) -> DataFrame:
    """Documents whose whole text, of LENGTH bytes or more, an earlier document has: they neither keep nor lend a byte."""
    rows = packed.select("part", "slice", F.posexplode(F.arrays_zip("ids", "ranks", "sizes", "digests")).alias("i", "doc")).where(F.col("doc.sizes") >= LENGTH)
    rows = rows.select("part", "slice", "i", F.col("doc.digests").alias("digest"), F.struct("slice", F.col("doc.ranks").alias("rank")).alias("order"))
    first = rows.groupBy("digest").agg(F.min("order").alias("first"), F.max("order").alias("last")).where("first <> last").drop("last")
    later = rows.join(first, "digest").where(F.col("order") > F.col("first"))
    return later.groupBy("part", "slice").agg(F.collect_list("i").alias("places"))


def _place_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [np.array(x, np.int32).tobytes() for x in batch.column("places").to_pylist()]
        yield pa.record_batch([batch.column("part"), batch.column("slice"), pa.array(places, pa.binary())], names=["part", "slice", "copies"])


def remove_repeats(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): every text, as UTF-8, without the bytes of 50-byte strings that
    also start in a document of smaller doc_id.

    Null counts as empty; a null doc_id is the largest. Rows that repeat a doc_id do not see each other, whatever their texts. Overlaps count, and
    strings are judged on the input. Columns beside doc_id and text are not read; an empty table gives an empty
    result. Strings are compared by 64-bit fingerprints.
    """
    scratch = Scratch(docs.sparkSession, "lpf")
    order = ["no_id", "doc_id"]
    ordered = docs.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    packed = scratch.keep(ordered.select("doc_id", "text").mapInArrow(_packer(slice_bytes), PACKED))
    total = packed.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    buckets = max(12, -(-total // BUCKET_BYTES))

    def exchange(send, answer) -> str:
        sent = packed.mapInArrow(send, SENT_TYPE).groupBy("bucket")
        return _keep_verdicts(scratch, sent.applyInArrow(answer, BACK_TYPE))

    copies = _keep_verdicts(scratch, _copies(packed).mapInArrow(_place_bytes, "part int, slice long, copies binary"))
    shared = exchange(_prefixes(copies, buckets), _shared)
    levels = exchange(_contexts(copies, shared, buckets), _ordered)
    repeated = exchange(_strings(copies, shared, levels, buckets), _repeated)
    return packed.mapInArrow(_cut(copies, shared, levels, repeated), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
