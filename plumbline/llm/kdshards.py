"""Shards of near-equal bytes by a K-d tree over document metadata.

The tree is grown one level at a time. For all nodes of a level at once, Spark finds the widest
dimension and then narrows the weighted median (weights are bytes) by histograms of the composite
sort key (coordinate, hash of the document), so documents that tie in a coordinate are split too. Only the split values
of the nodes reach the driver: at most one row per shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import Scratch, text_or_empty

COORDINATE_BITS = 24  # of a scaled coordinate
TIE_BITS = 24  # of the hash below it
KEY_BITS = COORDINATE_BITS + TIE_BITS
DIGIT_BITS = 16  # bins of one histogram
TOLERANCE = 5e-4  # a median may be off by this share of its node's bytes
BLOCKS = 64  # runs of slots that are numbered apart within a shard


@dataclass
class Tree:
    """Nodes numbered as in a heap: node n has the children 2n and 2n + 1; a leaf has no dimension (0)."""

    shards: dict[int, tuple[int, int]]  # first and last shard of a node
    dim: dict[int, int]  # from 1
    cut: dict[int, int]

    def leaves(self) -> list[int]:
        return [n for n in self.shards if n not in self.dim]

    def column(self, coordinates: Column) -> Column:
        """The leaf that a row is in: one step down the tree for each level."""
        dims, cuts = _by_node(self.dim, 0), _by_node(self.cut, 0)
        depth = max(n.bit_length() for n in self.shards)

        def step(node: Column, _: Column) -> Column:
            dim = F.element_at(dims, node.cast("int"))
            down = node * 2 + F.when(F.element_at(coordinates, dim.cast("int")) < F.element_at(cuts, node.cast("int")), 0).otherwise(1)
            return F.when(dim == 0, node).otherwise(down)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1).cast("long"), step)

    def shard(self, leaf: Column) -> Column:
        return F.element_at(_by_node({n: low for n, (low, _) in self.shards.items()}, 0), leaf.cast("int"))


def _by_node(values: dict[int, int], default: int) -> Column:
    """An array literal with an entry for each node from 1 on."""
    return F.expr("array(" + ", ".join(f"{values.get(n, default)}L" for n in range(1, max([1, *values]) * 2 + 2)) + ")")


def _text_coordinate(c: Column) -> Column:
    """Order-keeping number of a string's first six bytes; null as empty."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(c, F.lit("")), "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes and 16), text_crc32, and the coordinates of the tree: language, source, log size, id."""
    text = text_or_empty()
    size = F.octet_length(text).cast("long") + 16
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("tie"), _text_coordinate(F.col("lang")).alias("d0"), _text_coordinate(F.col("source")).alias("d1"),
        F.log2(size).alias("d2"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("double").alias("d3"),
    )


def _scaled(rows: DataFrame, dims: list[str]) -> DataFrame:
    """``coordinates``: integer sort keys, 24 bits of the place in the table's range, then 24 of the hash."""
    ends = rows.agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max)))).first()
    tie = F.shiftrightunsigned("tie", 64 - TIE_BITS)
    keys = []
    for d in dims:
        low, high = ends[f"low_{d}"] or 0.0, ends[f"high_{d}"] or 0.0
        place = F.lit(0.0) if high <= low else (F.col(d) - low) / (high - low) * ((1 << COORDINATE_BITS) - 1)
        keys.append(F.shiftleft(place.cast("long"), TIE_BITS) + tie)
    return rows.withColumn("coordinates", F.array(*keys)).drop(*dims)


def _split_level(rows: DataFrame, tree: Tree, dims: int) -> None:
    """Split every leaf of more than one shard."""
    leaves = [n for n in tree.leaves() if tree.shards[n][1] > tree.shards[n][0]]
    placed = rows.select("size", "coordinates", tree.column(F.col("coordinates")).alias("node"))
    at = [F.element_at("coordinates", d + 1) for d in range(dims)]
    spread = placed.where(F.col("node").isin(leaves)).groupBy("node").agg(
        F.sum("size").alias("bytes"), *(f(at[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("low", F.min), ("high", F.max)))
    ).collect()
    dim, cut = dict.fromkeys(leaves, 1), dict.fromkeys(leaves, 0)  # a node without rows is cut anywhere
    state = {}
    for r in spread:
        first, last = tree.shards[r["node"]]
        width = [(r[f"high{d}"] >> TIE_BITS) - (r[f"low{d}"] >> TIE_BITS) for d in range(dims)]
        dim[r["node"]] = width.index(max(width)) + 1
        share = ((first + last + 1) // 2 - first) / (last - first + 1)
        state[r["node"]] = {"from": 0, "to": 1 << KEY_BITS, "below": 0, "goal": int(share * r["bytes"]), "bytes": r["bytes"]}
    shift = KEY_BITS
    while state:
        shift -= DIGIT_BITS
        of = lambda name: F.element_at(_by_node({n: s[name] for n, s in state.items()}, 0), F.col("node").cast("int"))
        key = F.element_at("coordinates", F.element_at(_by_node(dim, 1), F.col("node").cast("int")).cast("int"))
        bins = (
            placed.where(F.col("node").isin(list(state))).select("node", "size", key.alias("key"), of("from").alias("from"), of("to").alias("to"))
            .where("key >= from and key < to").groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        )
        # a node has at most 2 ** DIGIT_BITS bins
        upto = F.sum("bytes").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        reached = bins.select("node", "bin", "bytes", (upto + of("below")).alias("upto"), of("goal").alias("goal")).where("upto >= goal")
        for r in reached.groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto")).alias("at")).collect():
            s, (at_bin, held, upto_bin) = state[r["node"]], r["at"]
            if shift == 0 or held <= TOLERANCE * s["bytes"]:
                over, under = upto_bin - s["goal"], s["goal"] - (upto_bin - held)
                cut[r["node"]] = (at_bin + (over < under)) << shift
                del state[r["node"]]
            else:
                s |= {"from": at_bin << shift, "to": (at_bin + 1) << shift, "below": upto_bin - held}
    for n in leaves:
        first, last = tree.shards[n]
        middle = (first + last + 1) // 2
        tree.shards |= {2 * n: (first, middle - 1), 2 * n + 1: (middle, last)}
    tree.dim |= dim
    tree.cut |= cut


def grow(rows: DataFrame, shards: int, dims: int) -> Tree:
    """A tree whose leaves are the shards; every split halves the shards and the bytes in proportion."""
    tree = Tree({1: (0, shards - 1)}, {}, {})
    while any(tree.shards[n][1] > tree.shards[n][0] for n in tree.leaves()):
        _split_level(rows, tree, dims)
    return tree


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: the ``bytes`` law, sizes of shards near equal.

    Either a number of shards or the bytes that a shard should have is given. Shards differ by the
    tolerance of the medians and at most a document at each cut, however a coordinate is repeated: documents with equal
    coordinates are split by a hash. Rows that repeat doc_id and text share that hash and stay together unless they are alone
    at a cut. Null text has no bytes; null lang, source and doc_id are coordinates of their own (empty, empty, 0).
    Columns beside doc_id, text, lang and source are not read; an empty table gives an empty result. Slots
    count from 0 in each shard: a shard's rows are numbered in blocks by hash, and the blocks' sizes added up.
    """
    scratch, dims = Scratch(docs.sparkSession, "kdshards"), ["d0", "d1", "d2", "d3"]
    rows = scratch.keep(metadata(docs))
    keyed = scratch.keep(_scaled(rows, dims))
    scratch.drop(rows)
    if target_bytes:
        total = keyed.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    tree = grow(keyed, shards, len(dims))
    leaf = keyed.select("*", tree.column(F.col("coordinates")).alias("leaf")).drop("coordinates")
    placed = leaf.withColumn("shard", tree.shard(F.col("leaf")).cast("int"))
    placed = placed.withColumn("block", F.pmod("tie", F.lit(BLOCKS)).cast("int"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "tie"))
    joined = placed.withColumn("number", number).join(starts, ["shard", "block"])
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number") - 1).alias("slot"))
