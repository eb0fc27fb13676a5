"""Exact deduplication over an extendible-hash index on shared files.

1. *Staging*: each task normalises its texts (runs of white space become one space), merges equal texts of one
   Arrow batch by comparing their bytes, and writes one *representative* with its text and a member row per document.
   A group of copies, however large, so leaves each batch as one representative.
2. *Hot keys*: a key whose representatives overfill a bucket (a text that is a third of all rows has one in every
   batch) is dealt over many tasks by a salt; each compares bytes along its chain and hands on one representative for
   each different text. This is repeated until no key overfills a bucket, sixteen to one or better a round.
3. *Directory*: the bytes under each prefix of the 64-bit key are summed; starting from a single bucket, an overfull
   bucket is split on its next bit, and the directory doubles whenever a bucket grows deeper than the directory. The
   driver's directory stops at MAX_DEPTH bits; a bucket that is overfull there has a directory of its own: its keys'
   next bits, as many as its bytes ask for, doubled while the distributed sums still find an overfull one. So no bucket
   grows with the data.
4. *Owners*: a task owns a key range, one bucket or, beyond MAX_OWNERS of them, several neighbours. It reads its
   representatives in key order, chains the different texts that share a key, compares bytes along the chain, and
   writes the entries of its buckets. It holds the texts of one key at a time.

Only representatives travel with their text, once (those of hot keys twice).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import drop_stored, small_table, stored

BUCKET_BYTES = 32 << 20
#: Bits of the driver's directory: at most 2**17 rows of it.
MAX_DEPTH = 17
#: Tasks of the owners at most; a scheduling limit, beyond which each has several buckets.
MAX_OWNERS = 1 << 17
#: Representatives that one task merges at least, however long the texts.
MERGED = 16
#: Hot keys up to this number are broadcast (16 bytes each), more are joined by a shuffle.
_BROADCAST = 1 << 20

_SPACES = frozenset(b" \t\n\x0b\x0c\r")
_NO_ID = (1 << 63) - 1


def squeeze(raw: bytes) -> bytes:
    """Every run of `[\\x20\\x09-\\x0D]` as one space; no trimming."""
    words = raw.split()
    out = b" ".join(words)
    if raw and raw[0] in _SPACES:
        out = b" " + out
    if words and raw[-1] in _SPACES:
        out += b" "
    return out


def _key(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm) - (1 << 63)


def _stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 36
    serial = 0
    for batch in batches:
        ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
        slot_of: dict[bytes, int] = {}
        member: list[int] = []
        seen: set[tuple[int, int | None]] = set()
        again: list[int] = []  # 1: repeats a doc_id with an equal text
        best: list[int] = []
        count: list[int] = []
        norms: list[bytes] = []
        for i, raw in enumerate(texts):
            norm = squeeze(raw or b"")
            slot = slot_of.setdefault(norm, len(norms))
            if slot == len(norms):
                norms.append(norm)
                best.append(i)
                count.append(0)
            elif (_NO_ID if ids[i] is None else ids[i]) < (_NO_ID if ids[best[slot]] is None else ids[best[slot]]):
                best[slot] = i
            count[slot] += 1
            member.append(slot)
            again.append(int((slot, ids[i]) in seen))
            seen.add((slot, ids[i]))
        first, n = base + serial, len(texts)
        serial += len(norms)
        null = lambda kind, k: pa.nulls(k, kind)
        yield pa.record_batch(
            [pa.array([first + s for s in member], pa.int64()), pa.array(ids, pa.int64()), null(pa.int64(), n), null(pa.int64(), n), null(pa.string(), n), pa.array(again, pa.int64()), null(pa.string(), n), null(rows.type, n)],
            names=["rep", "id", "n", "key", "sha", "size", "text", "row"],
        )
        at = pa.array(best, pa.int64())
        yield pa.record_batch(
            [
                pa.array(range(first, first + len(norms)), pa.int64()),
                pa.array([ids[i] for i in best], pa.int64()),
                pa.array(count, pa.int64()),
                pa.array(map(_key, norms), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in norms], pa.string()),
                pa.array(map(len, norms), pa.int64()),
                batch.column(1).take(at),
                rows.take(at),
            ],
            names=["rep", "id", "n", "key", "sha", "size", "text", "row"],
        )


class _Chain:
    """The different texts under one key, and what is known of each."""

    def __init__(self, bucket: int, key: int):
        self.bucket, self.key, self.links = bucket, key, []

    def add(self, bucket: int, rep: int, doc_id: int | None, n: int, sha: str, size: int, text: bytes, row: object) -> None:
        norm = None
        for link in self.links:
            if norm is None:
                norm = squeeze(text)
            if link["norm"] is None:
                link["norm"] = squeeze(link["text"])
            if link["norm"] == norm:  # bytes, not digests
                link["reps"].append(rep)
                link["n"] += n
                if (_NO_ID if doc_id is None else doc_id) < (_NO_ID if link["id"] is None else link["id"]):
                    link.update(id=doc_id, keep=rep, text=text, row=row)
                return
        self.links.append({"bucket": bucket, "norm": norm, "text": text, "row": row, "id": doc_id, "keep": rep, "n": n, "sha": sha, "size": size, "reps": [rep]})


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Chain]]:
    """Chains in the order of (bucket, key); a chain is handed on once its key has ended."""
    chain = None
    for batch in batches:
        done = []
        bucket, key, rep, ids, n, sha, size = (batch.column(i).to_pylist() for i in range(7))
        texts, rows = batch.column(7).cast(pa.binary()).to_pylist(), batch.column(8) if batch.num_columns > 8 else None
        for i, k in enumerate(key):
            if chain is None or chain.key != k or chain.bucket != bucket[i]:
                if chain is not None:
                    done.append(chain)
                chain = _Chain(bucket[i], k)
            chain.add(bucket[i], rep[i], ids[i], n[i], sha[i], size[i], texts[i] or b"", rows[i] if rows is not None else None)
        yield done
    if chain is not None:
        yield [chain]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chains in _chains(batches):
        out = [(x["bucket"], c.key, k, rep, x["keep"], x["id"], x["n"], x["sha"]) for c in chains for k, x in enumerate(c.links) for rep in x["reps"]]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "key", "chain", "rep", "keep_rep", "keep_id", "group_size", "text_sha256"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A representative for each different text of each salted key, and those that it stands for."""
    for chains in _chains(batches):
        out = [(x["keep"], x["id"], x["n"], c.key, x["sha"], x["size"], x["text"].decode(), x["row"].as_py(), x["reps"]) for c in chains for x in c.links]
        if out:
            kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.string(), chains[0].links[0]["row"].type, pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["rep", "id", "n", "key", "sha", "size", "text", "row", "reps"])


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chains in _chains(batches):
        links = [x for c in chains for x in c.links]
        if links:
            row = pa.array([x["row"].as_py() for x in links], links[0]["row"].type)
            yield pa.record_batch([row], names=["row"])


def directory(histogram: dict[int, int], depth: int, capacity: int) -> tuple[int, list[int]]:
    """Split from one bucket until none holds more than `capacity` bytes or `depth` is reached.

    histogram: bytes under each prefix of `depth` bits. Returns the directory's depth and, for each of its
    2**depth prefixes, the bucket that it points to; buckets are numbered in key order.
    """
    sums = [0] * (1 << depth)
    for p, size in histogram.items():
        sums[p] += size
    levels = [sums]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([x[i] + x[i + 1] for i in range(0, len(x), 2)])
    levels.reverse()  # levels[d][p]: bytes under prefix p of d bits
    leaves, todo = [], [(0, 0)]
    while todo:
        d, p = todo.pop()
        if d < depth and levels[d][p] > capacity:
            todo += [(d + 1, 2 * p + 1), (d + 1, 2 * p)]
        else:
            leaves.append((d, p))
    deep = max(d for d, _ in leaves)  # each doubling of the directory adds one bit
    return deep, [b for b, (d, _) in enumerate(leaves) for _ in range(1 << (deep - d))]


def _staged(docs: DataFrame, carry: list[str]) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.struct(F.lit(None).cast("boolean").alias("none"))
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    schema = T.StructType([T.StructField(n, k) for n, k in (("rep", T.LongType()), ("id", T.LongType()), ("n", T.LongType()), ("key", T.LongType()), ("sha", T.StringType()), ("size", T.LongType()), ("text", T.StringType()), ("row", src.schema["row"].dataType))])
    return stored(src.mapInArrow(_stage, schema), "exact-staged")


def _merge_hot(reps: DataFrame, bucket_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The representatives, those of hot keys merged, and for each round (rep, via): what was merged into what."""
    links: list[DataFrame] = []
    look, was = reps, None
    while True:
        most = F.greatest(F.lit(MERGED), F.floor(F.lit(float(bucket_bytes)) * F.col("n") / F.greatest(F.col("bytes"), F.lit(1))))
        sums = look.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        hot = sums.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).alias("salts"), "n")
        hot = stored(hot, "exact-hot")
        count, left = hot.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not count or left == was:  # nothing to merge, or different texts only
            return reps, links
        was = left
        keys = hot.drop("n")
        keys = F.broadcast(keys) if count <= _BROADCAST else keys
        salted = reps.join(keys, "key").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
        dealt = salted.select("salt", "key", "rep", "id", "n", "sha", "size", "text", "row").repartition("key", "salt").sortWithinPartitions("salt", "key", "rep")
        merged = stored(dealt.mapInArrow(_merged, T.StructType([*reps.schema.fields, T.StructField("reps", T.ArrayType(T.LongType()))])), "exact-merged")
        links.append(merged.select(F.explode("reps").alias("rep"), F.col("rep").alias("via")))
        look = merged.drop("reps")
        reps = reps.join(keys.select("key"), "key", "left_anti").select(*reps.columns).unionByName(look)


def _owned(reps: DataFrame, bucket_bytes: int, with_row: bool, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The representatives dealt to the owners of their buckets, in key order."""
    spark = reps.sparkSession
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))

    def prefix(d: int) -> Column:
        return F.shiftrightunsigned(unsigned, 64 - d).cast("long") if d else F.lit(0).cast("long")

    total = reps.agg(F.sum("size")).first()[0] or 0
    depth = min(max_depth, max(1, math.ceil(math.log2(max(1, total) / bucket_bytes)) + 4 if total > bucket_bytes else 1))
    histogram = {r.p: r.s for r in reps.groupBy(prefix(depth).alias("p")).agg(F.sum("size").alias("s")).collect()}  # at most 2**max_depth rows
    deep, points = directory(histogram, depth, bucket_bytes)
    # buckets that are overfull at the directory's last bit: the bits of their own directories
    more = {p: math.ceil(math.log2(s / bucket_bytes)) for p, s in histogram.items() if s > bucket_bytes} if deep == max_depth else {}
    while True:
        base, first, at = [], {}, 0
        for p, b in enumerate(points):
            if b not in first:
                first[b] = at
                at += 1 << more.get(p, 0)
            base.append(first[b])
        rows = [{"p": p, "base": x, "more": more.get(p, 0)} for p, x in enumerate(base)]
        table = stored(small_table(spark, rows, "p bigint, base bigint, more int"), "exact-directory")
        placed = reps.withColumn("p", prefix(deep)).join(F.broadcast(table), "p")  # broadcast: at most 2**max_depth rows of 20 bytes
        further = F.call_function("shiftrightunsigned", unsigned, F.lit(64 - deep) - F.col("more")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("more")) - 1)
        placed = placed.withColumn("bucket", F.col("base") + F.when(F.col("more") > 0, further).otherwise(F.lit(0)))
        if not more:
            break
        full = placed.where("more > 0").groupBy("p", "bucket").agg(F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("z")).where((F.col("s") > bucket_bytes) & (F.col("a") < F.col("z")))
        over = [r.p for r in full.select("p").distinct().collect()]  # at most 2**max_depth rows
        if not over:
            break
        for p in over:
            more[p] += 1
    owners = min(at, MAX_OWNERS)
    cols = ["bucket", "key", "rep", "id", "n", "sha", "size", "text", *(["row"] if with_row else [])]
    owner = F.col("bucket") if owners == at else F.floor(F.col("bucket") * (owners / at))
    return placed.select(*cols, owner.cast("int").alias("owner")).repartitionById(owners, F.col("owner")).drop("owner").sortWithinPartitions("bucket", "key", "rep")


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of white space `[\\x20\\x09-\\x0D]` has become one space.
    Of equal texts the row with the smallest doc_id stays; a null doc_id counts as the largest. A null text counts
    as empty. Rows that repeat a doc_id with an equal text are one document: kept is true on one of them. An empty
    table gives an empty result; other columns of docs, whatever their names, are ignored.
    """
    staged = _staged(docs, [])
    reps, links = _merge_hot(staged.where("n IS NOT NULL"), bucket_bytes)
    dealt = _owned(reps, bucket_bytes, False, max_depth)
    entries = stored(dealt.mapInArrow(_entries, "bucket long, key long, chain int, rep long, keep_rep long, keep_id long, group_size long, text_sha256 string"), "exact-entries").drop("bucket", "key", "chain")
    for link in reversed(links):
        through = link.join(entries.withColumnRenamed("rep", "via"), "via").drop("via")
        entries = entries.join(link, "rep", "left_anti").unionByName(through)
    members = staged.where("n IS NULL").select("rep", F.col("id").alias("doc_id"), "size")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rep") == F.col("keep_rep")) & (F.col("size") == 0)
    return members.join(entries, "rep").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns; the same rules for nulls, ties and repeats."""
    staged = _staged(docs, docs.columns)
    reps, _ = _merge_hot(staged.where("n IS NOT NULL"), bucket_bytes)
    dealt = _owned(reps, bucket_bytes, True, max_depth)
    out = dealt.mapInArrow(_winners, T.StructType([T.StructField("row", staged.schema["row"].dataType)]))
    return out.select("row.*")


__all__ = ["directory", "drop_exact_copies", "drop_stored", "exact_groups", "squeeze"]
