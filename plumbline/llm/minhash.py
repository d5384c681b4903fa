"""MinHash near-dedup by an inverted join over signature coordinates.

Texts with the same set of shingles are one representative. Representatives are posted under their
(coordinate, value) pairs. Two of them that agree in at least ``matches`` of COORDINATES pairs share one of the
COORDINATES - matches + 1 rarest pairs of either (prefix), so only those are posted, and the frequent
ones are skipped and counted later from the two signatures. Candidates are confirmed on full sets.

A posting list with thousands of near copies is not turned into all its pairs: its most central
member is compared with the others first, then another one, then only members of different components with each other, as
far as they share a shingle that is rare enough in both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, Scratch, bytes_of, map_batches, row_key, slices
from plumbline.llm.graph import contract
from plumbline.llm.wordhash import MIX, WordHashes, mixed, shingles

WORDS = 5
COORDINATES = 64
MISS = 3e-6  # probability that a pair at the least similarity agrees in too few coordinates, at most: 40 at 0.85, 35 at 0.8
NO_ID = (1 << 63) - 1  # stands for a null doc_id: the largest


def matches(percent: int) -> int:
    """Coordinates in which a pair of the similarity agrees but for a probability of MISS."""
    p, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISS:
            return k
    return COORDINATES


_WORDS = WordHashes(SPACE.encode())


def shingles_in_order(text: bytes) -> np.ndarray:
    """64-bit hashes of all runs of WORDS words; of the whole sequence if it is shorter."""
    words = _WORDS(text)
    return shingles(words, min(WORDS, len(words))) if len(words) else words


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingles_in_order(text))


_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least 32-bit hash under each coordinate's function."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 2048):
        h = shingles[i : i + 2048]
        h = ((h ^ (h >> np.uint64(31)))[:, None] * _SEEDS) >> np.uint64(32)
        least = np.minimum(least, h.min(axis=0).astype(np.uint32))
    return least


SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, signature array<int>"


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    n, s1, s2, rows = [], [], [], []
    for text in bytes_of(batch.column("text")):
        found = shingle_set(text)
        digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
        n.append(len(found))
        s1.append(digest[0])
        s2.append(digest[1])
        rows.append(signature(found).view(np.int32))
    flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * COORDINATES), flat)
    return pa.record_batch(
        [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists],
        names=["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "signature"],
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [shingle_set(t).view(np.int64) for t in bytes_of(part.column("text"))]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int64()))
            yield pa.record_batch([part.column("node"), lists], names=["node", "shingles"])


def node(doc_id: Column, mark: Column) -> Column:
    """Representatives are ordered by doc_id, null last; the hash tells texts apart that share one."""
    return F.struct(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), mark.alias("mark"))


def _similar(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _rare_posts(reps: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(pair, node, n, weight): the posts of each representative under its rarest pairs that others have too.

    ``weight`` says how frequent a representative's shared pairs are altogether.
    """
    pairs = reps.select("node", "n_shingles", F.posexplode("signature").alias("i", "value"))
    pairs = pairs.select("node", "n_shingles", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("value").bitwiseAND(F.lit(0xFFFFFFFF))).alias("pair"))
    shared = pairs.groupBy("pair").agg(F.count("*").alias("freq")).where("freq > 1")
    met = pairs.join(shared, "pair").groupBy("node", "n_shingles").agg(F.collect_list(F.struct("freq", "pair")).alias("met"))
    # pairs that nobody shares are the rarest: they fill the prefix first and need no post
    prefix = F.lit(COORDINATES - matches(percent) + 1)
    rest = prefix - (F.lit(COORDINATES) - F.size("met"))
    met = met.where(rest > 0).select(
        "node", F.col("n_shingles").alias("n"), F.aggregate("met", F.lit(0.0), lambda s, x: s + F.log(x["freq"].cast("double"))).alias("weight"),
        F.explode(F.slice(F.sort_array("met"), F.lit(1), rest)).alias("post"),
    )
    return scratch.keep(met.select(F.col("post.pair").alias("pair"), "node", "n", "weight"))


def _sharing_rare_shingles(apart: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of the rarest shingles of both.

    Sets of the similarity share at least ``percent`` of the shingles of either, so they meet among its rarest rest and one more. A passage
    that many texts hold is not among these, unless it is nearly all of a text.
    """
    words = apart.join(sets, "node").select("node", "n", "root", F.explode("shingles").alias("shingle"))
    shared = words.groupBy("shingle").agg(F.count("*").alias("freq")).where("freq > 1")
    met = words.join(shared, "shingle").groupBy("node", "n", "root").agg(F.collect_list(F.struct("freq", "shingle")).alias("met"))
    # shingles that nobody shares are the rarest
    alone = F.col("n") - F.size("met")
    rest = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    posts = met.where(rest > 0).select("node", "n", "root", alone.alias("alone"), F.posexplode(F.slice(F.sort_array("met"), F.lit(1), rest)).alias("i", "post"))
    posts = posts.select("node", "n", "root", F.col("post.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("i")).alias("left"))
    posts = scratch.keep(posts)
    other = posts.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "root", "left")))
    # if this is the first shingle that both have, no more than ``left`` of either can be shared
    enough = F.least("left", "left2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    return posts.join(
        other,
        (posts.shingle == other.shingle) & (F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & _similar(F.col("n"), F.col("n2"), percent) & enough,
    ).select(F.col("node").alias("a"), F.col("node2").alias("b"))


def _confirmed(candidates: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``candidates`` that agree in enough coordinates and whose sets are similar."""
    sign = lambda s: reps.select(F.col("node").alias(s), F.col("signature").alias(f"sig_{s}"))
    full = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    close = candidates.distinct().join(sign("a"), "a").join(sign("b"), "b").where(agree >= matches(percent)).select("a", "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return close.join(full("b"), "b").join(full("a"), "a").where(both * 100 >= union * percent).select("a", "b")


def links(docs: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows and (node, root) of the representatives that link with others."""
    texts = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    signed = scratch.keep(map_batches(texts, _sign, SIGNED))
    first = F.min(F.struct(node(F.col("doc_id"), F.col("s1")).alias("node"), "k1", "k2"))
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(first.alias("first"), F.first("signature").alias("signature"))
    reps = scratch.keep(classes.select("first.*", "s1", "s2", "n_shingles", "signature"))
    posts = _rare_posts(reps, scratch, percent)
    posted = posts.select("node").distinct().join(reps, "node").select("node", "k1", "k2")
    sets = texts.join(posted, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])
    sets = scratch.keep(sets.mapInArrow(_sets, "node struct<doc:long,mark:long>, shingles array<long>"))

    # one member of each list against those of other components: first the most central one, then another of each list
    found, placed = None, posts.withColumn("root", F.col("node"))
    for chosen in (F.col("weight"), F.xxhash64("pair", "node.doc", "node.mark")):
        lead = placed.groupBy("pair").agg(F.max(F.struct(chosen.alias("by"), F.struct("node", "n", "root").alias("who"))).alias("lead"))
        lead = lead.select("pair", F.col("lead.who.node").alias("leader"), F.col("lead.who.n").alias("m"), F.col("lead.who.root").alias("led"))
        candidates = placed.join(lead, (placed.pair == lead.pair) & (F.col("root") != F.col("led")) & _similar(F.col("n"), F.col("m"), percent))
        candidates = candidates.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        new = scratch.keep(_confirmed(candidates, reps, sets, percent))
        found = new if found is None else found.unionAll(new)
        roots = contract(found, scratch)
        placed = scratch.keep(posts.join(roots, "node", "left").select("pair", "node", "n", "weight", F.coalesce("root", "node").alias("root")))

    # then members of different components, all of them that can be similar
    open_lists = placed.groupBy("pair").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("pair")
    apart = scratch.keep(placed.join(open_lists, "pair", "left_semi").select("node", "n", "root").distinct())
    more = scratch.keep(_confirmed(_sharing_rare_shingles(apart, sets, scratch, percent), reps, sets, percent))
    if not more.isEmpty():
        roots = contract(found.unionAll(more), scratch)
    # a class of equal sets keeps the hash of its first row as mark
    named = reps.select("node", "s1", "s2", F.col("n_shingles")).join(roots, "node")
    return signed, scratch.keep(named.select("s1", "s2", "n_shingles", "root"))


def near_duplicates(docs: DataFrame, percent: int = 85, carry: Sequence[str] = ()) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable, its own included), kept.
    Null, empty and wordless texts have no shingles and stand alone. A null doc_id is the
    largest, and a component of such rows alone has the component_id null; rows that repeat a doc_id are kept
    when it is the component's. With ``carry`` of k1 and k2 the key of each row comes along, with that of root what tells its component
    from others, null for a text that stands alone for lack of shingles. Equal sets are one class whatever its size. Columns beside doc_id and text are not
    read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    signed, roots = links(docs, scratch, percent)
    own = node(F.col("doc_id"), F.col("s1"))
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min(own).alias("first"))
    classes = classes.join(roots, ["s1", "s2", "n_shingles"], "left").select("s1", "s2", "n_shingles", F.coalesce("root", "first").alias("root"))
    joined = signed.select("doc_id", "n_shingles", "s1", "s2", *(c for c in carry if c != "root")).join(classes, ["s1", "s2", "n_shingles"], "left")
    component = F.coalesce(F.col("root.doc"), F.col("doc_id"), F.lit(NO_ID))
    component = F.when(component != NO_ID, component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *carry)
