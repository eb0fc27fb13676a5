"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes: every step shifts the sum left and adds a table value of the next byte, so the
16-bit hash at a place depends on the last 16 bytes only and an insertion shifts boundaries without changing them. A
chunk ends where the hash has zeros under a mask; normalised chunking takes a strict mask before the normal size and a
loose one after it, which draws the sizes together. The fingerprint is the set of the chunks' digests with their
lengths; how much of a document another contains is the length of the shared digests over that of its own. Texts of
less than MIN bytes or a little more are one chunk, so their likeness is 0 or 1.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import folded, small_table

MIN, NORMAL, MAX = 24, 64, 256
STRICT, LOOSE = 0x7F, 0x1F  # masks of 7 and 5 bits
ROWS_A_PART = 4000

#: 256 16-bit values, from a rule: two bytes of the digest of each byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear" + bytes([b])).digest()[:2], "little") for b in range(256)], np.uint16)
_PIECE = 1 << 22


def gear_hash(data: bytes) -> np.ndarray:
    """At each byte, the sum of GEAR[byte] << age over the last 16 bytes, in 16 bits: four doublings instead of a loop."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def _ends(data: bytes) -> tuple[list[int], list[int]]:
    """Where strict and loose boundaries may lie (a chunk's end, exclusive). Masks look at the high bits, which all 16 bytes reach."""
    loose: list[np.ndarray] = []
    strict: list[np.ndarray] = []
    for at in range(0, len(data), _PIECE):
        lead = min(at, 15)
        h = gear_hash(data[at - lead : at + _PIECE])[lead:] >> np.uint16(9)
        at_loose = np.flatnonzero((h & LOOSE) == 0)
        strict.append(at_loose[(h[at_loose] & STRICT) == 0] + at + 1)
        loose.append(at_loose + at + 1)
    return np.concatenate(strict).tolist(), np.concatenate(loose).tolist()


def chunks(data: bytes) -> list[int]:
    """The ends of the chunks of data; the last is its length. No data: no chunks."""
    n = len(data)
    if not n:
        return []
    strict, loose = _ends(data)
    out, s, i, j = [], 0, 0, 0
    ns, nl = len(strict), len(loose)
    while n - s > MIN:
        i = bisect_left(strict, s + MIN, i)
        if i < ns and strict[i] < s + NORMAL:
            s = strict[i]
        else:
            j = bisect_left(loose, s + NORMAL, j)
            s = loose[j] if j < nl and loose[j] < s + MAX else s + MAX
        if s >= n:
            break
        out.append(s)
    out.append(n)
    return out


def chunk_set(data: bytes) -> dict[int, int]:
    """The digests of the chunks of data, with their lengths."""
    digest, s, out = xxhash.xxh3_64_intdigest, 0, {}
    for e in chunks(data):
        out[digest(data[s:e])] = e - s
        s = e
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a (by length) that b contains; 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(a == b)
    return sum(a[k] for k in a.keys() & b.keys()) / sum(a.values())


def digest(a: dict[int, int]) -> str:
    """A 128-bit digest of a fingerprint: equal for equal sets of chunks."""
    return xxhash.xxh3_128_hexdigest(np.array(sorted(a.items()), "<u8").tobytes() if a else b"")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [chunk_set(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        kind = pa.list_(pa.struct([("digest", pa.int64()), ("length", pa.int32())]))
        col = pa.array([[{"digest": k - (1 << 63), "length": v} for k, v in sorted(s.items())] for s in sets], kind)
        yield pa.record_batch([batch.column(0), col], names=["doc_id", "chunks"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and chunks, the set of (digest, length), of every row. A null or empty text has the empty set."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_sets, "doc_id long, chunks array<struct<digest: long, length: int>>")


def _part(cuts: list[int]) -> Column:
    """The place of id among the ascending cuts, counted from the top: binary search in the literal array."""
    if not cuts:
        return F.lit(0)
    arr, m = folded(cuts, "array<bigint>"), len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(m.bit_length()))])

    def step(pos: Column, k: Column) -> Column:
        return F.when((pos + k <= m) & (F.try_element_at(arr, pos + k) <= F.col("id")), pos + k).otherwise(pos)

    return F.lit(m) - F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The rows of docs dealt to ranges of doc_id in descending order, each range followed by the first row of the next one.

    Columns doc_id, text, echo (the row stands for the next range's first). The ranges hold about rows_a_part
    rows; their bounds and first ids come from the ids alone, and the driver sees one row a range (32 768 at most; larger
    tables have larger ranges, which tasks sort on disk and stream). Ties go by text.
    """
    least = -(1 << 63)  # stands for a null doc_id, which comes last
    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), text.alias("text"))
    n = src.count()
    parts = max(1, min(n // rows_a_part, 1 << 15))
    cuts: list[int] = []
    if parts > 1:
        cuts = sorted({int(x) for x in src.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 4 * parts)).first()[0]} - {least})
    src = src.withColumn("part", _part(cuts))
    tops = {r["part"]: r["top"] for r in src.groupBy("part").agg(F.max("id").alias("top")).collect()}  # a row for each range
    order = sorted(tops)
    firsts = small_table(docs.sparkSession, [{"part": p, "top": tops[p], "before": order[k - 1]} for k, p in enumerate(order)], "part int, top bigint, before int")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("echo"))
    echo = F.struct(F.col("before").alias("part"), F.lit(True).alias("echo"))
    at = F.explode(F.when(F.col("id") == F.col("top"), F.array(own, echo)).otherwise(F.array(own)))
    dealt = src.join(F.broadcast(firsts), "part").select("id", "doc_id", "text", at.alias("at")).select("at.part", "at.echo", "id", "doc_id", "text")
    return dealt.repartitionById(max(order, default=0) + 1, F.col("part")).sortWithinPartitions("echo", F.col("id").desc(), "text").select("doc_id", "text", "echo")


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        out = []
        for doc_id, text, echo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = (doc_id, text or "", chunk_set((text or "").encode()))
            if held is not None:
                out.append(_compare(held, row))
            held = row
            if echo:  # the range is complete
                held = None
                break
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_LIKENESS)
        if held is None:
            for _ in batches:  # further rows of the same first id
                pass
            return


def _compare(row: tuple, after: tuple) -> dict:
    doc_id, text, own = row
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[1][:half]).encode()
    other = chunk_set(edited)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited).hexdigest(),
        "fingerprint": digest(own),
        "edited_fingerprint": digest(other),
        "near_edited": containment(own, other),
        "near_next": containment(own, after[2]),
    }


_LIKENESS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def next_likeness(docs: DataFrame, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """How much of each document its edited text and the next document contain.

    The next document is the one before in ascending doc_id; after the last comes the first, and a single document
    is its own next. Null doc_ids come last, equal doc_ids go by text. The edited text has the last half (rounded
    down) of the code points replaced by as many of the next document's first, or all it has. Empty and null texts
    have the empty fingerprint, which contains and is contained in the empty one only. An empty table gives an empty
    result; other columns are ignored.
    """
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, rows_a_part).mapInArrow(_likeness, kinds)
