"""Packing token sequences: non-negative least squares over shallow length combinations.

1. Each task tokenizes its documents, cuts off whole windows, and writes what is left (the *tail*, shorter than a
   window) with its ids, its length and its rank among the tails of that length in its task.
2. The driver sees a histogram of at most `window` lengths. All combinations of two and three lengths that fill a
   window exactly are enumerated (some 87 000 where every length occurs), and the repeat counts that explain the
   histogram best are solved by non-negative least squares over all of them and rounded down. Tails in combinations
   stay whole and leave no padding.
3. What remains is packed greedily: length by length, end to end, cut at each window's edge. The last window is cut
   into powers of two.

The plan is a table of rank intervals for each length (a few thousand rows, bounded by the window), so a tail finds
its place from its length and global rank alone; no task needs to see the others' tails. Global ranks are local ranks
plus sums over (task, length) counts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm.common import small_table, stored

WINDOW = 1024
TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Combinations that enter the active set in a round of the least squares; all that gain enter in the end.
_ENTER = 512


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from a text to its ids (uint32), equal to the tokenizers library's with add_special_tokens=False.

    The byte-level BPE of the JSON file runs in tiktoken, about five times as fast and with the same ids. Texts that
    its regular expressions can't take (very long runs of white space) go to the tokenizers library itself.
    """
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec["pre_tokenizer"]
    plain = Tokenizer.from_file(path)
    slow = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
    if spec["model"]["type"] != "BPE" or pre is None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["post_processor"]:
        return slow
    # the printable stand-ins of bytes in byte-level vocabularies
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except BaseException as e:  # the Rust side panics where a regular expression runs out of stack
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


def _cut(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokenizer(path), TaskContext.get().partitionId()
        ranks = [0] * window
        wholes = serial = 0
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("doc", "doc_id", "start", "length", "crc", "doc_tokens", "rank", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                n = len(ids)
                for at in range(0, n, window):
                    part = ids[at : at + window].tobytes()
                    length = len(part) // 4
                    if length == window:
                        rank, wholes = wholes, wholes + 1
                    else:
                        rank, ranks[length] = ranks[length], ranks[length] + 1
                    for k, v in zip(cols, (serial, doc_id, at, length, zlib.crc32(part), n, rank, None if length == window else part), strict=True):
                        cols[k].append(v)
                serial += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array([task] * len(cols["doc"]), pa.int32()), *[pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)]], names=["task", *cols])

    return run


def combinations(hist: np.ndarray) -> np.ndarray:
    """Rows of two or three lengths (0: none) that sum to the window, from lengths that occur: all of them."""
    window = len(hist)
    have = np.flatnonzero(hist[1:]) + 1
    pairs = [(a, window - a, 0) for a in have if a <= window - a and hist[window - a] > 0]
    a, b = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
    c = window - a - b
    ok = (a <= b) & (b <= c) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    some = hist[c] > 0
    return np.vstack([np.array(pairs, np.int64).reshape(-1, 3), np.stack([a[some], b[some], c[some]], 1)])


def solve(hist: np.ndarray, combos: np.ndarray, rounds: int = 200, tolerance: float = 1e-3) -> np.ndarray:
    """Repeat counts x >= 0 for which the lengths used come closest to hist in the least-squares sense, as floats.

    Non-negative least squares with an active set: each time all combinations are priced against what is left, those
    with the largest gains enter, and the active ones are solved by accelerated projected gradient, until no
    combination gains (the conditions of Karush, Kuhn and Tucker, to `tolerance` of the first gain). The matrix has a
    column of at most three entries for each combination, so it is applied by indexing. Errors weigh by 1 / sqrt(count),
    so that rare lengths are fitted too.
    """
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    window = len(hist)
    scale = 1 / np.sqrt(np.maximum(hist, 1.0))
    scale[0] = 0
    target = hist * scale

    def use(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], v, window) for k in range(3)) * scale

    def gains(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
        return sum((r * scale)[rows[:, k]] for k in range(3))

    active, first = np.zeros(len(combos), bool), None
    while True:
        gain = gains(combos, target - use(combos, x))
        first = first or max(gain.max(), 1e-12)
        enter = np.flatnonzero(~active & (gain > tolerance * first))
        if not len(enter):
            return x
        active[enter[np.argsort(-gain[enter], kind="stable")[:_ENTER]]] = True
        at = np.flatnonzero(active)
        rows = combos[at]
        v = np.ones(len(rows))
        for _ in range(20):
            v = gains(rows, use(rows, v))
            v /= np.linalg.norm(v) or 1
        step = 1 / max(np.linalg.norm(gains(rows, use(rows, v))) * 1.05, 1e-12)
        new = y = x[at]
        t = 1.0
        for _ in range(rounds):
            old, new = new, np.maximum(y + step * gains(rows, target - use(rows, y)), 0)
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / nt * (new - old), nt
        x[at] = new


def plan(hist: np.ndarray) -> tuple[list[dict], list[int], int]:
    """Intervals of ranks: {length, lo, hi, seq, offset, rest}; the ends of the last, short sequences; the number of full ones in the greedy part.

    Ranks lo..hi-1 of a length go to sequences seq, seq + 1, ... at offset; or, where rest is true, end to end from
    position offset of the greedy part, whose first sequence is seq.
    """
    window = len(hist)
    left = hist.astype(np.int64).copy()
    combos = combinations(hist)
    counts = np.floor(solve(hist.astype(float), combos) + 1e-6).astype(np.int64)
    used = np.zeros(window, np.int64)
    out, seq = [], 0

    def take(combo: tuple[int, ...], k: int) -> int:
        nonlocal seq
        lengths = [x for x in combo if x]
        k = min(k, *(int(left[x]) // lengths.count(x) for x in lengths))
        if k > 0:
            offset = 0
            for x in lengths:
                out.append({"length": x, "lo": int(used[x]), "hi": int(used[x]) + k, "seq": seq, "offset": offset, "rest": False})
                used[x] += k
                left[x] -= k
                offset += x
            seq += k
        return k

    order = np.argsort(-counts, kind="stable")
    for j in order[counts[order] > 0]:
        take(tuple(int(x) for x in combos[j]), int(counts[j]))
    for j in order:  # what rounding down has left
        if all(left[x] for x in combos[j] if x):
            take(tuple(int(x) for x in combos[j]), int(left.max(initial=0)))
    at = 0
    for x in range(window - 1, 0, -1):
        if left[x]:
            out.append({"length": x, "lo": int(used[x]), "hi": int(used[x] + left[x]), "seq": seq, "offset": at, "rest": True})
            at += int(left[x]) * x
    full, tail = divmod(at, window)
    ends = []
    while tail:
        bit = 1 << (tail.bit_length() - 1)
        ends.append((ends[-1] if ends else full * window) + bit)
        tail -= bit
    return out, ends, full


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then `end`; a null or empty text is `end` alone. Each id lies in exactly one
    piece, each sequence holds `window` ids (the last few: a power of two), offsets and sequence ids are gapless from
    0. Rows are packed one by one, so repeated rows and null doc_ids are packed as they are; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "task int, doc long, doc_id long, start long, length int, crc long, doc_tokens long, rank long, ids binary"
    cut = stored(src.mapInArrow(_cut(path, window, end), schema), "pack-pieces")
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.withColumn("before", F.coalesce(before, F.lit(0))), "pack-counts")
    hist = np.zeros(window, np.int64)
    wholes = 0
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        if r["length"] == window:
            wholes = r["n"]
        else:
            hist[r["length"]] = r["n"]
    spans, ends, full = plan(hist)
    table = small_table(spark, spans, "length int, lo bigint, hi bigint, seq bigint, offset bigint, rest boolean")
    table = stored(table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "seq", "offset", "rest"))).alias("spans")), "pack-plan")
    rank = F.col("rank") + F.col("before")
    # the counts grow with the tasks, so they are not broadcast
    placed = cut.drop("ids").join(counts.select("task", "length", "before").hint("shuffle_hash"), ["task", "length"]).withColumn("rank", rank).drop("before")
    whole = placed.where(F.col("length") == window).select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    span = F.get(F.filter("spans", lambda x: (F.col("rank") >= x["lo"]) & (F.col("rank") < x["hi"])), F.lit(0))
    tails = placed.where(F.col("length") < window).join(table, "length").withColumn("s", span).drop("spans")  # the plan: at most `window` rows
    tails = tails.withColumn("k", F.col("rank") - F.col("s.lo")).withColumn("pos", F.col("s.offset") + F.when(F.col("s.rest"), F.col("k") * F.col("length")).otherwise(F.lit(0)))
    # the edges inside a piece of the greedy part
    edges = F.array(*[F.lit(x).cast("long") for x in ends]) if ends else F.array().cast("array<bigint>")
    first = (F.floor(F.col("pos") / window) + 1) * window
    inside = F.filter(F.array_union(F.array(first.cast("long")), edges), lambda e: (e > F.col("pos")) & (e < F.col("pos") + F.col("length")))
    tails = tails.withColumn("cuts", F.when(F.col("s.rest"), inside).otherwise(F.array().cast("array<bigint>")))
    parts = F.concat(F.array("pos"), "cuts", F.array(F.col("pos") + F.col("length")))
    shut = full * window
    ended = F.size(F.filter(edges, lambda e: e <= F.col("q")))
    in_full = F.col("q") < shut
    sequence = F.when(~F.col("s.rest"), F.col("s.seq") + F.col("k")).when(in_full, F.col("s.seq") + F.floor(F.col("q") / window)).otherwise(F.col("s.seq") + full + ended)
    offset = F.when(~F.col("s.rest"), F.col("s.offset")).when(in_full, F.col("q") % window).otherwise(F.col("q") - F.when(ended > 0, F.get(edges, ended - 1)).otherwise(F.lit(shut)))

    def rows(df: DataFrame, start: Column, length: Column, crc: Column) -> DataFrame:
        return df.select("doc_id", start.cast("long").alias("start"), length.cast("long").alias("length"), crc.alias("ids_crc32"), "doc_tokens", (sequence + wholes).cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    kept = tails.where(F.size("cuts") == 0).withColumn("q", F.col("pos"))
    # pieces that a window's edge cuts need their ids again, for the check sums of their parts
    split = tails.where(F.size("cuts") > 0).withColumn("parts", parts).select("task", "doc", "doc_id", "start", "doc_tokens", "s", "k", "pos", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("i"))
    split = split.withColumn("q", F.element_at("parts", F.col("i"))).withColumn("len", F.element_at("parts", F.col("i") + 1) - F.col("q")).withColumn("skip", F.col("q") - F.col("pos"))
    split = split.join(cut.where("ids IS NOT NULL").select("task", "doc", "ids"), ["task", "doc"])
    crc = F.crc32(F.substr("ids", (4 * F.col("skip") + 1).cast("int"), (4 * F.col("len")).cast("int")))
    out = rows(kept, F.col("start"), F.col("length"), F.col("crc")).unionByName(rows(split, F.col("start") + F.col("skip"), F.col("len"), crc))
    return whole.unionByName(out)
