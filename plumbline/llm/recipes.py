"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its last bytes says so. Equal chunks get one verified
identifier; a document is then the ordered list of its identifiers, and only these short lists are
grouped and compared. Text moves once, as the chunks that are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, Scratch, bytes_of, map_batches, row_key, slices

WINDOW = 8  # bytes that decide a cut
SEGMENT = 1 << 20  # bytes hashed at a time
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def cut_points(data: bytes, mean_bits: int = 10, most: int = 1 << 14) -> list[int]:
    """Ends of the chunks of ``data``: cuts depend on the bytes before them alone, at most ``most`` apart."""
    a, found = np.frombuffer(data, np.uint8), []
    for start in range(0, max(0, len(a) - WINDOW + 1), SEGMENT):
        part = a[start : start + SEGMENT + WINDOW - 1].astype(np.uint64)
        n = len(part) - WINDOW + 1
        rolled = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            rolled = rolled * MULTIPLIER + part[i : n + i]
        rolled ^= rolled >> np.uint64(29)
        hits = np.flatnonzero((rolled * MULTIPLIER) >> np.uint64(64 - mean_bits) == 0)
        found.append(hits + (start + WINDOW))
    ends, last = [], 0
    for end in [*(np.concatenate(found).tolist() if found else []), len(a)]:
        while end - last > most:
            last += most
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def _chunks(data: bytes, hash_bits: int) -> Iterator[tuple[int, bytes]]:
    start = 0
    for end in cut_points(data):
        chunk = data[start:end]
        yield xxhash.xxh3_64_intdigest(chunk) >> (64 - hash_bits), chunk
        start = end


def _signed(values: list[int]) -> list[int]:
    return np.array(values, np.uint64).view(np.int64).tolist()


def _recipes(hash_bits: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0).cast(pa.int64())
        digests, sizes, hashes, lengths = [], [], [], []
        for raw in bytes_of(batch.column("text")):
            data = raw.translate(None, SPACE.encode())
            found = list(_chunks(data, hash_bits))
            digests.append(hashlib.sha256(data).hexdigest())
            sizes.append(len(data))
            hashes.append(_signed([h for h, _ in found]))
            lengths.append([len(c) for _, c in found])
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), points, pa.array(sizes, pa.int64()),
             pa.array(digests, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32()))],
            names=["doc_id", "k1", "k2", "n_points", "n_bytes", "text_sha256", "hashes", "sizes"],
        )

    return make


RECIPE = "doc_id long, k1 long, k2 long, n_points long, n_bytes long, text_sha256 string, hashes array<long>, sizes array<int>"


def _bodies(hash_bits: int):
    """Distinct chunks of each run of rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen = {
                    (h, c) for raw in bytes_of(part.column("text"))
                    for h, c in _chunks(raw.translate(None, SPACE.encode()), hash_bits)
                }
                if seen:
                    hashes, chunks = zip(*seen)
                    yield pa.record_batch(
                        [pa.array(_signed(list(hashes)), pa.int64()), pa.array([len(c) for c in chunks], pa.int32()),
                         pa.array(chunks, pa.binary())], names=["hash", "size", "body"])

    return make


def _placed(hash_bits: int):
    """Every chunk with the row and place it has."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [
                    (k1, k2, i, h, c)
                    for k1, k2, raw in zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), bytes_of(part.column("text")))
                    for i, (h, c) in enumerate(_chunks(raw.translate(None, SPACE.encode()), hash_bits))
                ]
                if rows:
                    k1, k2, place, hashes, chunks = zip(*rows)
                    yield pa.record_batch(
                        [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(place, pa.int32()),
                         pa.array(_signed(list(hashes)), pa.int64()), pa.array([len(c) for c in chunks], pa.int32()),
                         pa.array(chunks, pa.binary())], names=["k1", "k2", "place", "hash", "size", "body"])

    return make


def identifier_clashes(texts: DataFrame, hash_bits: int) -> DataFrame:
    """(hash, size) of chunks that share both and still differ in their bytes."""
    bodies = texts.mapInArrow(_bodies(hash_bits), "hash long, size int, body binary")
    compared = bodies.groupBy("hash", "size").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return compared.where("low <> high").select("hash", "size")


def chunk_recipes(docs: DataFrame, scratch: Scratch, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_points, n_bytes, text_sha256, recipe.

    ``recipe`` is the ordered list of verified chunk identifiers: hashes, sizes, and for places whose
    hash stands for several different chunks the SHA-256 of the chunk.
    """
    texts = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    recipes = scratch.keep(map_batches(texts, _recipes(hash_bits), RECIPE))
    clashes = scratch.keep(identifier_clashes(texts.select("text"), hash_bits))
    none = F.array().cast("array<struct<place:int,digest:string>>")
    if clashes.isEmpty():
        fixed = recipes.withColumn("variants", none)
    else:
        placed = texts.mapInArrow(_placed(hash_bits), "k1 long, k2 long, place int, hash long, size int, body binary")
        placed = placed.join(clashes, ["hash", "size"])
        named = F.struct("place", F.sha2("body", 256).alias("digest"))
        lists = placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(named)).alias("variants"))
        fixed = recipes.join(lists, ["k1", "k2"], "left").withColumn("variants", F.coalesce("variants", none))
    return fixed.select("doc_id", "n_points", "n_bytes", "text_sha256", F.struct("hashes", "sizes", "variants").alias("recipe"))


def _first(points: Column, doc_id: Column) -> Column:
    return F.struct((-points).alias("points"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


def exact_duplicates(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Groups of equal texts, white space aside: one row per document, dropped ones too.

    doc_id, keep_id, group_size, kept, text_sha256, n_bytes. The row with the most code points stays,
    then the smallest doc_id; a null doc_id is the largest. Null and empty texts are equal to each other
    and to texts of white space alone. Of rows that repeat doc_id and text, one is kept. Columns
    beside doc_id and text are not read; an empty table gives an empty result. Long and repeated
    texts need nothing special: groups are counted by partial aggregates, and the join back is one that
    adaptive execution can split.
    """
    scratch = Scratch(docs.sparkSession, "recipes")
    rows = chunk_recipes(docs, scratch, hash_bits)
    same = rows.groupBy("doc_id", "n_points", "n_bytes", "text_sha256", "recipe").agg(F.count("*").alias("copies"))
    same = scratch.keep(same)
    groups = same.groupBy("recipe").agg(
        F.sum("copies").alias("group_size"), F.min(_first(F.col("n_points"), F.col("doc_id"))).alias("best")
    )
    joined = same.join(groups, "recipe").select(
        "*", _first(F.col("n_points"), F.col("doc_id")).eqNullSafe(F.col("best")).alias("is_best"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("is_best") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_bytes",
    )
