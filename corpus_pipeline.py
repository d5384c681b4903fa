"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, langid, linededup, minhash
from plumbline.llm.common import Scratch, row_key
from plumbline.llm.queries import MIN_DOCS, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = 80  # percent of shingles from which two documents are near duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by compression; ``lang`` keeps what the table says.

    The classifier learns from the documents whose id allows it. Texts without letters, null ones, and those between two languages go.
    """
    languages = langid.fit(docs.where(langid.learns(F.col("doc_id"))).select("text", "lang"))
    return langid.predict(docs, languages, *docs.columns).where("not rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many documents have; ``n_chars`` follows the text."""
    left = linededup.drop_repeated_lines(docs, MIN_DOCS, carry=[c for c in docs.columns if c not in ("text", "n_chars")])
    left = left.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, null last, and of the smallest key among those.

    Rows with the same doc_id and text are one document, texts without words too: the least of them stays.
    """
    rows = minhash.near_duplicates(docs, NEAR, carry=["k1", "k2", "root"])
    alone = F.col("root").isNull()
    groups = rows.groupBy("root", F.when(alone, F.col("k1")).alias("g1"), F.when(alone, F.col("k2")).alias("g2"))
    kept = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("least")).select("least.k1", "least.k2")
    keyed = docs.select("*", *row_key("doc_id", "text")).join(kept, ["k1", "k2"], "left_semi")
    return keyed.groupBy("k1", "k2").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = docs.select("*", *row_key("doc_id", "text"))
    found = decontam.leaks(keyed, table(spark, sf_dir, "benchmark"), "k1", "k2").select("k1", "k2")
    return keyed.join(found, ["k1", "k2"], "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256 (of the text decoded from the ids)."""
    encoded = bpe.encode(docs, tokenizer_path(), "doc_id", "lang", "source", decode=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe_tokens", tokens),
]

# compression and fingerprints have no SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written once and read by the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    scratch, before = Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
