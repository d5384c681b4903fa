"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir

# the white space of every contract here: [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two never-null 64-bit hashes that name a row by its id and text, for joins back to it.

    Rows that repeat both are the same document and share the key.
    """
    null_id = F.col(id_col).isNull()
    return [
        F.xxhash64(F.lit(1), null_id, F.col(id_col), F.col(text_col)).alias("k1"),
        F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col), null_id).alias("k2"),
    ]


class Scratch:
    """Results written once to the shared folder, removed together when they are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, shared_dir(spark, name), 0
        self.paths, self.held = {}, []

    def keep(self, df: DataFrame, *partitioned: str) -> DataFrame:
        """Write ``df`` and read it back; a lost executor costs nothing that was written."""
        path = f"{self.path}/{self.count}"
        self.count += 1
        writer = df.write.partitionBy(*partitioned) if partitioned else df.write
        writer.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        self.held.append(kept)
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Remove the files behind results of ``keep`` that nothing reads any more."""
        for df in kept:
            self._delete(self.paths.pop(id(df)))

    def clear(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes; a longer text stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def carried(df: DataFrame, carry: Sequence[str]) -> tuple[list[Column], str, dict[str, str]]:
    """Columns to take along under names of their own, their types for a schema string, and the names they get back."""
    kinds = "".join(f"c{i} {kind}, " for i, (_, kind) in enumerate(df.select(*carry).dtypes))
    return [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], kinds, {f"c{i}": c for i, c in enumerate(carry)}
