"""Line dedup over the whole corpus.

Line hashes are range-partitioned by (hash, document) and sorted with the place last, so that each
task streams runs of one hash and counts its documents; a hash in many documents spreads over several
ranges and its partial counts are added. What goes back to a document is a compressed bitmap of the
lines it keeps, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, UPPER, Scratch, carried, row_key, text_or_empty

HASH = ["h1", "h2"]
DOC = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, k1, k2, doc, place) of every line whose key is not empty; ``doc`` is the id that is counted."""
    lines = docs.select(
        *row_key("doc_id", "text"), "doc_id", F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("place", "line")
    ).withColumn("key", line_key(F.col("line")))
    return lines.where(F.length("key") > 0).select(
        F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"),
        F.col("doc_id").isNull().alias("no_id"), "doc_id", *DOC, "place",
    )


RUN = "h1 long, h2 long, n_docs long, first_no_id boolean, first_id long, first_k1 long, first_k2 long, first_place int"


def _stream_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per hash of this range, with its number of documents and its first occurrence.

    A run may go on in the next batch: its last hash is carried over as (row, last document).
    """
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, k1, k2, place = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "k1", "k2", "place"))
        no_id = batch.column("no_id").to_numpy(zero_copy_only=False)
        ids = pa.compute.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
        new_hash = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_hash | np.r_[True, (ids[1:] != ids[:-1]) | (no_id[1:] != no_id[:-1])]
        starts = np.flatnonzero(new_hash)
        counts = np.add.reduceat(new_doc.astype(np.int64), starts)
        first = [[x[i].item() for i in starts] for x in (h1, h2)] + [counts.tolist()] + [
            [x[i].item() for i in starts] for x in (no_id, ids, k1, k2, place)
        ]
        rows = [list(r) for r in zip(*first)]
        if carried:
            row, last = carried
            if row[:2] == rows[0][:2]:
                row[2] += rows[0][2] - (last == (no_id[0], ids[0]))
                rows[0] = row
            else:
                rows.insert(0, row)
        carried = (rows.pop(), (no_id[-1], ids[-1]))
        if rows:
            yield _run_batch(rows)
    if carried:
        yield _run_batch([carried[0]])


def _run_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in RUN.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, first) of the keys found in at least ``min_docs`` documents."""
    order = [*HASH, "no_id", "doc_id"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, *DOC, "place")
    runs = ranged.mapInArrow(_stream_runs, RUN)
    first = F.struct("first_no_id", "first_id", "first_place", "first_k1", "first_k2")
    return runs.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.min(first).alias("first")).where(F.col("n_docs") >= min_docs)


def _bitmap(batch: pa.RecordBatch) -> pa.RecordBatch:
    maps = []
    for places in batch.column("dropped").to_pylist():
        keep = np.ones(-(-(max(places) + 1) // 8) * 8, bool)
        keep[places] = False
        maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
    return pa.record_batch([batch.column("k1"), batch.column("k2"), pa.array(maps, pa.binary())], names=["k1", "k2", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(k1, k2, keep) of the documents that lose lines; ``keep`` is a zlib-compressed bitmap, lines
    behind its end are kept."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(hashed_lines(docs))
    heavy = scratch.keep(repeated_lines(lines, min_docs))
    gone = lines.join(heavy, HASH)
    if keep_first:
        gone = gone.where(
            ~(F.col("place").eqNullSafe(F.col("first.first_place")) & (F.col("k1") == F.col("first.first_k1"))
              & (F.col("k2") == F.col("first.first_k2")))
        )
    places = gone.groupBy(*DOC).agg(F.collect_set("place").alias("dropped"))
    kept = scratch.keep(places.mapInArrow(lambda it: map(_bitmap, it), "k1 long, k2 long, keep binary"))
    scratch.drop(lines, heavy)
    return kept


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, dropped = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
            lines = (text or "").split("\n")
            left = lines
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
                left = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
            total.append(len(lines))
            dropped.append(len(lines) - len(left))
            texts.append("\n".join(left) if keep is not None else text)
        columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("text", "keep")]
        names = [n for n in batch.schema.names if n not in ("text", "keep")]
        yield pa.record_batch(
            [*columns, pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
            names=[*names, "kept_text", "n_lines", "n_dropped"],
        )


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with kept_text, n_lines, n_dropped: every document without the lines that at least
    ``min_docs`` documents have.

    A line's key is the line without white space at its ends, A-Z in lower case; empty keys stay. The
    documents of a key are counted by distinct doc_id, null as one of them, so rows that repeat a
    doc_id count once. With ``keep_first`` the first occurrence by doc_id and place stays. A null or
    empty text has one empty line; a text that loses nothing is returned as it is, null too. Columns
    beside doc_id, text and ``carry`` are not read; an empty table gives an empty result.
    """
    maps = keep_bitmaps(docs, min_docs, keep_first)
    columns, kinds, names = carried(docs, carry)
    keyed = docs.select(*columns, "text", *row_key("doc_id", "text"))
    joined = keyed.join(maps, DOC, "left").drop(*DOC)
    left = joined.mapInArrow(_apply, kinds + "kept_text string, n_lines long, n_dropped long")
    return left.withColumnsRenamed(names)
