"""SimHash near-duplicates: pigeonhole blocks, Hamming check, connected components.

The 64 fingerprint bits are cut into `blocks` blocks. Two fingerprints that differ in at most d bits agree in all but
d blocks at most, so they share at least one key made of `blocks - d` whole blocks; joining on those keys finds every
link. Equal fingerprints are one node, so copies make no pairs.

A key that many different fingerprints share (a large group of near copies) would make the square of its size in
pairs. Beyond `block_pairs` nodes a key is not joined with itself; the bits that it leaves open are cut into blocks
again, by the same argument, and its nodes are joined on the longer keys. Keys of 64 bits in 4 blocks with 2 bits apart
fix 32 bits, then 48, then 56: a key of the last round leaves 8 bits open, so that no more than 256 different
fingerprints can share it, and is joined whatever its size. So pairs grow as nodes, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import drop_stored, stored

SHINGLE, BITS_APART, BLOCKS, BLOCK_PAIRS, SEED = 3, 2, 4, 16, 42
#: A key that leaves so many bits open has at most 2**8 different fingerprints.
OPEN_BITS = 8
_PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; a bit is 1 if over half the shingle hashes have it."""
    words = text.lower().split()  # of bytes: A-Z, and the white space of the contract
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        part = words[at : min(at + _PIECE, n) + shingle - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(shingle)], strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(part) - shingle + 1)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        fp = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.record_batch([*batch.columns[:-1], pa.array(fp)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (signed) of every row, stored in the shared folder."""
    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return stored(src.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long"), "simhash")


def block_masks(blocks: int, apart: int) -> list[int]:
    """The masks of all keys: unions of `blocks - apart` of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    of = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [sum(m) for m in combinations(of, blocks - apart)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def refined(mask: int, blocks: int, apart: int) -> list[int]:
    """Longer masks for two values that agree under mask: its open bits cut into blocks again."""
    bits = [b for b in range(64) if not mask >> b & 1]
    edges = [len(bits) * k // blocks for k in range(blocks + 1)]
    of = [sum(1 << b for b in bits[edges[k] : edges[k + 1]]) for k in range(blocks)]
    return sorted({mask | sum(m) for m in combinations(of, blocks - apart)})


def links(nodes: DataFrame, blocks: int = BLOCKS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """All links a < b between different fingerprints that are at most 2 bits apart.

    nodes: fp, all different.
    """
    masks, found = block_masks(blocks, BITS_APART), None
    keyed = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m"))
    while True:
        # keys of few open bits are joined whatever their size
        last = max(64 - m.bit_count() for m in masks) <= OPEN_BITS
        keyed = keyed.select("fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("v"))
        sizes = keyed.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        keyed = stored(keyed.join(sizes, ["m", "v"]), "simhash-keys")
        few = keyed if last else keyed.where(F.col("n") <= block_pairs)
        a, b = few.select("m", "v", F.col("fp").alias("a")), few.select("m", "v", F.col("fp").alias("b"))
        pairs = a.join(b, ["m", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS_APART)).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        many = keyed.where(F.col("n") > block_pairs).select("fp", "m")
        if last or many.isEmpty():
            return found.distinct()
        # a longer key can come from several shorter ones
        longer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(z)) for z in refined(m, blocks, BITS_APART)]))])
        keyed = many.select("fp", F.explode(F.element_at(longer, F.col("m"))).alias("m")).distinct()
        masks = sorted({z for m in masks for z in refined(m, blocks, BITS_APART)})


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b; a < b), by alternating stars.

    Large star: a node's larger neighbours go to its smallest neighbour; small star: its smaller neighbours and the
    node itself do. Each step is a join with a minimum, so no neighbourhood is gathered; the number of rounds grows
    as the logarithm of the longest path. Each round is a table in the shared folder.
    """
    cur = stored(edges, "links")
    mark = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        up = large.where("a < b")
        low = up.groupBy("b").agg(F.min("a").alias("m"))
        small = up.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        new = stored(small, "links")
        drop_stored(cur)
        cur = new
        was, mark = mark, tuple(new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if was == mark:
            return cur.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_groups(docs: DataFrame, blocks: int = BLOCKS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp, root (the component), component_id (the smallest doc_id in it).

    Texts without words, null ones too, have fingerprint 0 and are linked like others. A null doc_id is never a
    component's id unless all of its rows have none. Rows may repeat; an empty table gives an empty result; other
    columns are ignored.
    """
    prints = fingerprints(docs)
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), blocks, block_pairs))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(placed.join(named, "root").select("fp", "root", "component_id"), "simhash-groups")
    return prints.join(of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of near-duplicates, with all columns of docs.

    Rows that repeat both doc_id and text are one document, and one row of it stays. Where several texts of a group
    share the smallest doc_id, or none has a doc_id, the text with the smallest hash stays. The decision travels as
    (doc_id, hash of the text); the smallest long stands for a null doc_id there.
    """
    groups = near_groups(docs)
    never = F.lit(-(1 << 63))
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("text_hash").alias("h"))
    stay = stored(stay.select(F.coalesce("component_id", never).alias("id"), "h").distinct(), "simhash-stay")
    repeats = not groups.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    held = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), never).alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    kept = held.join(stay, ["id", "h"], "left_semi")
    return (kept.dropDuplicates(["id", "h"]) if repeats else kept).select("row.*")


__all__ = ["components", "fingerprint", "keep_one_of_each", "links", "near_groups"]
