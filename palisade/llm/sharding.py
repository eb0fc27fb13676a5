"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Documents with equal texts form one group and stay together. A group's weight is the bytes of its documents; its
place is given by the length of its text, its source and its language, and by a hash that tells apart groups equal in
those. The tree splits every node heavier than the target at the weighted median along its widest dimension; both
ranges and medians come from distributed sums, one pair of jobs for all nodes of a level. The leaves are then dealt
to the shards, heaviest first, each to the lightest shard.

A group heavier than a leaf's target is a leaf of its own. Copies are merged into their group by partial sums, so a
group with a third of all rows costs no task more than its share. Medians are picked by window functions over at most
512 bins a node; the driver sees two rows for each open node of a level and holds the tree, which reaches the tasks as
one constant. Its size depends on the number of leaves, a parameter, not on the rows: some 100 bytes a leaf, so that
10 000 shards are 24 MB of it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import folded, stored

LEAVES_A_SHARD = 24
_BINS = 512
_ROWS_A_RANK = 20_000
_DIMS = ("length", "source", "lang", "hash")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _unit(c: str) -> Column:
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).cast("binary")) / float(1 << 32)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, group and the metadata of every row, stored: the only pass over the texts."""
    have = set(docs.columns)
    meta = [(_unit(c) if c in have else F.lit(0.0)).alias(c) for c in ("source", "lang")]
    text = _text()
    return stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("crc"),
            F.xxhash64(text).alias("group"),
            F.log2(F.octet_length(text) + 1.0).alias("length"),
            *meta,
        ),
        "shard-sizes",
    )


class Tree:
    """A k-d tree under construction: node k has the children 2k and 2k + 1; a row goes left if its value is below the cut."""

    def __init__(self) -> None:
        self.cut: dict[int, tuple[int, float]] = {}
        self.leaves: dict[int, int] = {}

    def node_of(self, columns: list[str]) -> Column:
        """The leaf or open node of a row, found in the arrays of the tree."""
        if not self.cut:
            return F.lit(1).cast("long")
        nodes = sorted(self.cut)
        split = F.map_from_entries(folded([{"key": k, "value": {"d": d + 1, "v": v}} for k, (d, v) in sorted(self.cut.items())], "array<struct<key:bigint,value:struct<d:int,v:double>>>"))
        place = F.array(*[F.col(c) for c in columns])

        def step(node: Column, _: Column) -> Column:
            s = F.try_element_at(split, node)
            return F.when(s.isNull(), node).otherwise(2 * node + (F.element_at(place, s["d"]) >= s["v"]).cast("long"))

        depth = max(nodes).bit_length()
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1).cast("long"), step)


def build_tree(groups: DataFrame, leaf_bytes: float, scale: list[float]) -> Tree:
    """Split until leaves hold leaf_bytes at most or are single groups.

    groups: weight and the dimensions. scale: the range of each dimension over all groups, by which widths compare.
    """
    tree, dims = Tree(), list(_DIMS)
    open_nodes = {1}
    while open_nodes:
        at = groups.withColumn("node", tree.node_of(dims))
        if tree.cut:
            at = at.where(F.array_contains(folded(sorted(open_nodes), "array<bigint>"), F.col("node")))
        spans = at.groupBy("node").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)]).collect()  # a row for each open node
        plans = []
        for r in spans:
            if r["w"] <= leaf_bytes or r["n"] == 1:
                tree.leaves[r["node"]] = r["w"]
                continue
            width = [(r[f"max_{c}"] - r[f"min_{c}"]) / s if s else 0.0 for c, s in zip(dims, scale, strict=True)]
            d = max(range(len(dims) - 1), key=lambda k: width[k]) if max(width[:-1]) > 1e-9 else len(dims) - 1
            lo, hi = r[f"min_{dims[d]}"], r[f"max_{dims[d]}"]
            if hi > lo:
                plans.append({"node": r["node"], "d": d + 1, "lo": lo, "step": (hi - lo) / _BINS, "w": r["w"], "hi": hi})
            else:
                tree.leaves[r["node"]] = r["w"]
        open_nodes = set()
        if not plans:
            break
        plan = F.map_from_entries(folded([{"key": p["node"], "value": {k: p[k] for k in ("d", "lo", "step")}} for p in plans], "array<struct<key:bigint,value:struct<d:int,lo:double,step:double>>>"))
        bins = at.withColumn("p", F.try_element_at(plan, F.col("node"))).where("p IS NOT NULL")
        value = F.element_at(F.array(*[F.col(c) for c in dims]), F.col("p.d"))
        bins = bins.select("node", "weight", F.least(F.floor((value - F.col("p.lo")) / F.col("p.step")), F.lit(_BINS - 1)).cast("int").alias("bin"), value.alias("v"))
        sums = bins.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("v").alias("v"))
        # the cut before the bin at which the weights on both sides are nearest; at most _BINS rows for each node in a window
        below = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        whole = F.sum("w").over(Window.partitionBy("node"))
        cuts = sums.withColumn("below", below).withColumn("off", F.abs(2 * F.col("below") - whole)).where("below IS NOT NULL")
        found = {r["node"]: r["best"]["v"] for r in cuts.groupBy("node").agg(F.min(F.struct("off", "bin", "v")).alias("best")).collect()}  # a row for each open node
        for p in plans:
            # one bin holds all but is wider than a value: cut off its largest
            tree.cut[p["node"]] = (p["d"] - 1, float(found.get(p["node"], p["hi"])))
            open_nodes |= {2 * p["node"], 2 * p["node"] + 1}
    return tree


def deal(leaves: dict[int, int], shards: int) -> dict[int, int]:
    """The shard of each leaf: heaviest leaf first, to the lightest shard so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for node, w in sorted(leaves.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[node] = s
        heapq.heappush(heap, (load + w, s))
    return out


def shard_rows(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, crc, shard, slot (0, 1, ... in each shard).

    size is the UTF-8 bytes of the text plus 1 (null: 1). Rows with equal texts share a shard; null and empty texts
    are equal. Shards are as near in bytes as whole groups allow. target_bytes is the most that a leaf of
    more than one group holds; by default 1/24 of a shard. The driver's tree grows with the number of leaves. Null doc_ids, sources and languages are values like others; rows may repeat; an empty table gives an
    empty result; docs may lack source and lang, and other columns are ignored.
    """
    rows = measured(docs)
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"), F.min("length").alias("length"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    groups = stored(groups.withColumn("hash", (F.xxhash64("group") / float(1 << 64)) + 0.5), "shard-groups")
    ends = groups.agg(F.sum("weight").alias("w"), *[f(c).alias(f"{f.__name__}_{c}") for c in _DIMS for f in (F.min, F.max)]).first()
    if ends["w"] is None:
        return rows.select("doc_id", "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaf = target_bytes or ends["w"] / (shards * LEAVES_A_SHARD)
    tree = build_tree(groups, leaf, [ends[f"max_{c}"] - ends[f"min_{c}"] for c in _DIMS])
    of = deal(tree.leaves, shards)
    leaf = F.map_from_entries(folded([{"key": k, "value": s} for k, s in sorted(of.items())], "array<struct<key:bigint,value:int>>"))
    placed = groups.select("group", F.element_at(leaf, tree.node_of(list(_DIMS))).alias("shard"))
    out = stored(rows.join(placed, "group").select("doc_id", "size", "crc", "shard", F.monotonically_increasing_id().alias("number")), "shard-rows")
    return with_slots(out)


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard without putting a shard into one task: ranks within bounded cells plus the sizes of the cells before.

    Rows without a doc_id, however many, go to cells by their number in the stored table.
    """
    n = rows.count()
    cells = max(1, n // _ROWS_A_RANK)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("number")).otherwise(F.xxhash64("doc_id", "crc"))
    x = rows.withColumn("cell", F.pmod(key, F.lit(cells)))
    sums = x.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "crc"))
    y = x.withColumn("rank", rank).join(sums, ["shard", "cell"])
    return y.select("doc_id", "size", "crc", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
