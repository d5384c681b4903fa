"""Language ID by compression.

For every language a raw-content zstandard dictionary is made of sampled texts. A text is compressed with
each dictionary in turn; the language whose dictionary gives the fewest bytes is the answer, and
how far the second one lies behind tells how sure it is. Only letters count: texts are lower-cased and
runs of anything else become one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bytes_of, carried

SAMPLES = 128  # texts of a language that the dictionary is fitted on, at most
SAMPLE_CHARS = 2048  # letters and spaces of each, at most
LEVEL = 6
BLOCK = 128 << 10  # bytes of a text compressed at a time; each block starts from the dictionary anew
UNKNOWN = "und"
MIN_MARGIN = 0.002  # saving over the second language below which a prediction is rejected, for texts of any length


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))


@dataclass(frozen=True)
class Languages:
    """Dictionary content by language, the most frequent language first."""

    content: dict[str, bytes]


def fit(labelled: DataFrame, samples: int = SAMPLES, sample_chars: int = SAMPLE_CHARS) -> Languages:
    """Dictionaries from rows with ``text`` and ``lang``.

    The sample is bounded by ``samples`` texts of each language, ``sample_chars`` characters of each: the text
    of the smallest hash in each of ``samples`` hash buckets. Counts, which order languages of equal
    size, are over all rows. Null texts and languages are left out.
    """
    rows = labelled.where("text is not null and lang is not null").select(
        "lang", "text", F.xxhash64("text").alias("hash"), F.pmod(F.xxhash64("text", F.lit(1)), F.lit(samples)).alias("bucket")
    )
    picked = rows.groupBy("lang", "bucket").agg(F.min("hash").alias("hash"), F.count("*").alias("n"))
    # picked has at most ``samples`` rows for each language, so it goes to the texts and no text is shuffled but the picked ones
    texts = rows.join(F.broadcast(picked), ["lang", "bucket", "hash"]).groupBy("lang", "bucket", "hash", "n").agg(
        F.first(F.substring(letters(F.col("text")), 1, sample_chars)).alias("text")
    )
    found, counts = defaultdict(list), defaultdict(int)
    for r in texts.collect():
        found[r["lang"]].append((r["hash"], r["text"]))
        counts[r["lang"]] += r["n"]
    order = sorted(found, key=lambda x: (-counts[x], x))
    return Languages({x: "\n".join(t for _, t in sorted(found[x])).encode() for x in order})


class Classifier:
    def __init__(self, languages: Languages, level: int = LEVEL):
        self.names, self.packers = list(languages.content), []
        for content in languages.content.values():
            # content of 8 bytes or less is no dictionary
            data = zstandard.ZstdCompressionDict(content.ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.packers.append(
                zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score (saving over the second language) and whether the margin is too narrow."""
        if not text or not self.packers:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        score = 1.0 if second is None else 1 - sizes[best] / second
        return self.names[best], score, score < MIN_MARGIN


def predict(docs: DataFrame, languages: Languages, *carry: str) -> DataFrame:
    """The columns ``carry`` of every document with lang_pred, score and rejected.

    lang_pred is ``und`` for a null text and one without letters, which is also rejected, as is a text of any length
    whose two best languages differ by less than MIN_MARGIN. Equal sizes go to the more frequent language. Whole texts are read;
    nothing beside ``text`` decides. Repeated rows get equal predictions; an empty table gives an empty result.
    """
    columns, kinds, names = carried(docs, carry)
    rows = docs.select(*columns, letters(F.col("text")).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(languages)
        for batch in batches:
            found = [model.predict(x) for x in bytes_of(batch.column("letters"))]
            told, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(told, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    schema = kinds + "lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(run, schema).withColumnsRenamed(names)


def learns(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 3, is not 1. A null id may."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 != 1, F.lit(True))
