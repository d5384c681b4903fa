"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Every word of a text weighs as much as it occurs. A sample draws for each word, from hashes of the word and the sample's
number, r and c of a Gamma(2, 1) distribution and b of a uniform one; with t = floor(ln(weight) / r + b) the word's value is
c exp(-r (t - b + 1)), and the least value of a text picks one pair of word and t. Two texts pick the same pair with the
probability of their generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger ones; the share of
equal samples estimates it. Four samples share r and b of a word, and each has its own c: every sample still collides with that
probability, and as different samples pick different words the spread of the share hardly grows.

Words are hashed, sorted and run-length counted inside their row; then each distinct word is one row of a generated stage that keeps
the least value of every sample by text, so only fingerprints cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_CLASS, Scratch, row_key, text_or_empty

SAMPLES = 32
SHARED = 4  # samples that take r and b from the same draw
DIGITS = 7  # hexadecimal ones of a sample's name for its pair
MIX = 0x9E3779B97F4A7C15  # fixed value: 2**64 over the golden ratio, spreads consecutive numbers over 64 bits


def long_literal(x: int) -> Column:
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def uniform(bits: Column, at: int, width: int) -> Column:
    """A number inside (0, 1) from ``width`` bits of a hash."""
    return (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("double") + 0.5) / float(1 << width)


def values(word: Column, log_weight: Column, samples: int) -> list[Column]:
    """The word's value in every sample. It depends on the word, t and the sample alone, so equal least values name equal pairs."""
    out = []
    for number in range(samples):
        if number % SHARED == 0:
            drawn = F.xxhash64(word.bitwiseXOR(long_literal(MIX * (2 * number + 1))))
            r = -F.ln(uniform(drawn, 0, 21) * uniform(drawn, 21, 21))
            b = uniform(drawn, 42, 21)
            shrink = F.exp(r * (b - F.floor(log_weight / r + b) - 1.0))
        own = F.xxhash64(word.bitwiseXOR(long_literal(MIX * (2 * number + 2))))
        out.append(-F.ln(uniform(own, 0, 31) * uniform(own, 31, 31)) * shrink)
    return out


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """The columns ``keys``, which name a text, with its samples (array of int); null for a null, empty or blank text.

    Words are what white space ``[\\x20\\x09-\\x0D]`` parts, in lower case. Rows with equal keys have to hold the same text; they
    give one row. A text longer than others only has more words in its row. An empty table gives an empty result.
    """
    lower = F.lower(text_or_empty())
    words = F.sort_array(F.transform(F.array_remove(F.split(lower, f"{SPACE_CLASS}+"), ""), lambda w: F.xxhash64(w)))
    rows = texts.select(*keys, words.alias("words")).withColumn(
        # places at which a run of equal words starts
        "starts", F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: ~F.get("words", i).eqNullSafe(F.get("words", i - 1)))
    )
    runs = rows.select(*keys, "words", "starts", F.posexplode_outer("starts").alias("run", "start"))
    weight = F.get("starts", F.col("run") + 1) - F.col("start")
    weighted = runs.select(*keys, F.get("words", "start").alias("word"), F.ln(weight.cast("double")).alias("log_weight"))
    least = [F.min(v).alias(f"sample{i}") for i, v in enumerate(values(F.col("word"), F.col("log_weight"), samples))]
    found = weighted.groupBy(*keys).agg(*least)
    named = [F.shiftrightunsigned(F.xxhash64(f"sample{i}"), 64 - 4 * DIGITS).cast("int") for i in range(samples)]
    return found.select(*keys, F.when(F.col("sample0").isNotNull(), F.array(*named)).alias("samples"))


def as_text(samples: Column) -> Column:
    """The samples as hexadecimal digits one after the other; empty for none."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), DIGITS, "0")), ""), F.lit(""))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal samples: 1 between two texts without words, 0 between such a text and another."""
    same = F.size(F.filter(F.arrays_zip(one.alias("x"), other.alias("y")), lambda p: p["x"] == p["y"])) / F.size(one)
    return F.when(one.isNull() & other.isNull(), 1.0).when(one.isNull() | other.isNull(), 0.0).otherwise(same)


def followers(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """Distinct documents (k1, k2, ``id_col``, n_chars, copies) with the key (n1, n2) of the next one, descending ``id_col``, null last; the first follows the last.

    Only ids move: they are range-partitioned, each follows its neighbour inside a partition, and the first of every
    partition follows the last of the one before.
    """
    ids = docs.select(*row_key(id_col, "text"), id_col, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    ids = ids.groupBy("k1", "k2").agg(F.any_value(id_col).alias(id_col), F.any_value("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    order = [F.desc_nulls_last(id_col), F.asc("k1"), F.asc("k2")]
    placed = scratch.keep(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    rows = placed.withColumns({"place": F.row_number().over(inside), "next": F.lead(F.struct("k1", "k2")).over(inside)})
    # one row for each partition
    firsts = rows.where("place = 1").select("part", F.struct("k1", "k2").alias("first"))
    along, all_parts = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(all_parts)).alias("after"))
    linked = rows.join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "after"))
    return scratch.keep(linked.select("k1", "k2", id_col, "n_chars", "copies", F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2")))


def edited(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Of every distinct document (k1, k2) its text (which 0) and edited texts: with the start of the next document (1) and, if copies follow it, of itself (2)."""
    texts = docs.select(*row_key("doc_id", "text"), text_or_empty().alias("text")).groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    wanted = links.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), cut.alias("cut"), "n_chars", "copies")
    heads = texts.join(wanted, ["k1", "k2"]).select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.substring("text", F.lit(1), F.col("cut")).alias("head"), "cut", "n_chars", "copies"
    )
    body = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int"))
    versions = [
        F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("which"), F.concat(body, "head").alias("text")),
    ]
    copied = F.struct(F.lit(2).alias("which"), F.concat(body, F.substring("text", F.lit(1), F.col("cut"))).alias("text"))
    all_versions = F.when(F.col("copies") > 1, F.array(*versions, copied)).otherwise(F.array(*versions))
    return texts.join(heads, ["k1", "k2"]).select("k1", "k2", F.explode(all_versions).alias("version")).select("k1", "k2", "version.*")


def edit_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and how like it is to that text and to the next document.

    The edited text has the last third of the code points, rounded down, replaced by as many first ones of the next document,
    descending doc_id, null last and ties by hashes; of rows that repeat, all but the last are followed by a copy. A null text counts as
    empty. An empty table gives an empty result. Columns beside doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "cws")
    links = followers(docs, scratch)
    versions = edited(docs, links).withColumn("sha", F.unhex(F.sha2("text", 256)))
    signed = scratch.keep(fingerprints(versions, ["k1", "k2", "which", "sha"], samples))
    own = signed.where("which = 0").select("k1", "k2", F.col("samples").alias("own"))
    after = signed.where("which = 0").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("samples").alias("after"))
    made = signed.where("which > 0").select("k1", "k2", "which", "sha", F.col("samples").alias("made"))
    rows = links.join(own, ["k1", "k2"]).join(after, ["n1", "n2"]).join(made, ["k1", "k2"])
    times = F.when(F.col("which") == 1, F.lit(1).cast("long")).otherwise(F.col("copies") - 1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return rows.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("made")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("made")).alias("near_edited"),
        likeness(F.col("own"), F.when(F.col("which") == 1, F.col("after")).otherwise(F.col("own"))).alias("near_next"),
    )
