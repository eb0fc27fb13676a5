"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

*Word vectors.* Words, in lower case, are hashed to BUCKETS rows. Each row has a sparse index vector (a few +1 and -1,
drawn from a seeded generator); a word's vector is its index vector plus the mean of its neighbours' index vectors in
all texts, labelled or not.

*Pooling.* A document is the mean of its words' vectors, their spread (the standard deviation of each dimension) and
the mean of the products of adjacent ones, which words that follow each other as they do in other texts, or repeat,
raise. Nothing but word vectors goes in. Whole texts are read, in pieces.

*Network.* tanh hidden layer and a logistic output in numpy, trained by Adam on a bounded sample of labelled rows;
a temperature found on rows kept from training makes the scores probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import stored

BUCKETS, DIM = 1 << 15, 64
WIDTH = 3 * DIM
#: The bound on labelled rows of each label that the classifier is fitted on.
SAMPLE = 4000
THRESHOLD = 0.3
_PIECE = 1 << 14
#: Words whose neighbours are added up at once.
_BATCH = 1 << 18
_CACHE = 200_000
#: Rows of a table of buckets that are worked out at once.
_ROWS = 1 << 11


class _Codes(dict):
    """word -> its bucket; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        code = self[word] = zlib.crc32(word.lower()) % BUCKETS
        return code


_codes = _Codes()


def index_vectors(rows: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors of length 1: four +1 or -1 at random places."""
    rng = np.random.default_rng(seed)
    at = np.empty((rows, 4), np.int64)
    for k in range(0, rows, _ROWS):  # the same numbers as in one call, without its tables of all rows
        at[k : k + _ROWS] = np.argsort(rng.random((min(_ROWS, rows - k), dim)), axis=1)[:, :4]
    out = np.zeros((rows, dim), np.float32)
    np.put_along_axis(out, at, rng.choice(np.float32([-0.5, 0.5]), (rows, 4)), axis=1)
    return out


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's words, in pieces that overlap by one word."""
    words = (text or "").encode().split()
    for at in range(0, len(words), _PIECE):
        part = words[max(0, at - 1) : at + _PIECE]
        yield np.fromiter(map(_codes.__getitem__, part), np.int64, len(part))


def pool(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and mean product of neighbours of the vectors of a text's words; zeros for no words."""
    total, squares, products = np.zeros((3, vectors.shape[1]), np.float64)
    n = 0
    for codes in pieces(text):
        v = vectors[codes]
        new = v[1:] if n else v
        total += new.sum(0)
        squares += np.einsum("ij,ij->j", new, new)
        products += np.einsum("ij,ij->j", v[1:], v[:-1])
        n += len(new)
    mean = total / max(1, n)
    return np.concatenate([mean, np.sqrt(np.maximum(squares / max(1, n) - mean * mean, 0)), products / max(1, n)])


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    w1: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))
    b1: np.ndarray = field(default_factory=lambda: np.zeros(1))
    w2: np.ndarray = field(default_factory=lambda: np.zeros(1))
    b2: float = 0.0
    temperature: float = 1.0
    #: Added to the logits: from the sample's share of label 1 to that of all labels.
    prior: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.prior, -30, 30)))


def learn_vectors(texts: Iterator[str | None]) -> np.ndarray:
    """For each bucket, the sum of its neighbours' index vectors and, in the last column, the number of its places.

    The sums are multiples of one half, which float64 holds exactly: tables of parts of the texts add up to the same in any order.
    """
    index = index_vectors(BUCKETS, DIM, 1)
    at = np.argsort(index == 0, axis=1, kind="stable")[:, :4]
    signs = np.take_along_axis(index, at, axis=1).astype(np.float64)
    out = np.zeros((BUCKETS, DIM + 1), np.float64)
    held: list[np.ndarray] = []  # pieces
    again: list[bool] = []  # whether a piece's first word is the last of the piece before

    def add() -> None:
        b = np.concatenate(held)
        firsts = np.cumsum([0, *map(len, held[:-1])])
        inner = np.ones(len(b), bool)
        inner[firsts] = False
        right = np.flatnonzero(inner)
        for word, near in ((b[right], b[right - 1]), (b[right - 1], b[right])):
            places = (word[:, None] * DIM + at[near]).ravel()
            out[:, :DIM] += np.bincount(places, signs[near].ravel(), BUCKETS * DIM).reshape(BUCKETS, DIM)
        out[:, DIM] += np.bincount(b, minlength=BUCKETS) - np.bincount(b[firsts[again]], minlength=BUCKETS)
        held.clear()
        again.clear()

    n = 0
    for text in texts:
        for k, codes in enumerate(pieces(text)):
            held.append(codes)
            again.append(k > 0)
            n += len(codes)
            if n >= _BATCH:
                add()
                n = 0
    if held:
        add()
    return out


def neighbour_sums(docs: DataFrame) -> np.ndarray:
    """The table of learn_vectors over every row of docs: each task's table is added up by bucket in a shuffle."""
    names = [f"c{i}" for i in range(DIM + 1)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = learn_vectors(t for b in batches for t in b.column(0).to_pylist())
        seen = np.flatnonzero(part[:, DIM])
        yield pa.record_batch([pa.array(seen, pa.int32()), *[pa.array(np.rint(2 * part[seen, i]).astype(np.int64)) for i in range(DIM + 1)]], names=["bucket", *names])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(sums, "bucket int, " + ", ".join(f"{c} long" for c in names))
    got = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIM + 1), np.float64)
    at = got["bucket"].to_numpy()
    for i, c in enumerate(names):
        out[at, i] = got[c].to_numpy() / 2  # halves travel as whole numbers
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    out = index_vectors(BUCKETS, DIM, 1)
    for k in range(0, BUCKETS, _ROWS):
        part = sums[k : k + _ROWS]
        out[k : k + _ROWS] = out[k : k + _ROWS] + part[:, :DIM] / np.maximum(1, part[:, DIM:])  # added as float64
    return out


def train(model: Model, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 3) -> Model:
    """Fit the network to rows x with labels y; prior: the share of label 1 is that of y. Every fifth row sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cal, fit = order[::5], np.setdiff1d(order, order[::5])
    model.mean, model.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    d = x.shape[1]
    p = {"w1": rng.normal(0, d**-0.5, (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(1)}
    m, v, t = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    for epoch in range(rounds):
        rate = 0.01 * (1 - epoch / rounds) + 1e-4
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(z[at] @ p["w1"] + p["b1"])
            out = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30)))
            e = (out - y[at]) / len(at)
            back = np.outer(e, p["w2"]) * (1 - h * h)
            g = {"w1": z[at].T @ back + 1e-3 * p["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-3 * p["w2"], "b2": np.array([e.sum()])}
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"][0])
    logits, best = model.logits(x[cal]), (np.inf, 1.0)
    for k in np.geomspace(0.25, 8, 61):
        q = 1 / (1 + np.exp(-np.clip(logits / k, -30, 30)))
        loss = -np.mean(y[cal] * np.log(q + 1e-9) + (1 - y[cal]) * np.log(1 - q + 1e-9)) if len(cal) else 0.0
        best = min(best, (loss, float(k)))
    model.temperature = best[1]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 0 when divided by 5; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all of docs; the network is fitted on at most `sample` labelled documents of each label that are
    not held out: those with the smallest hash of doc_id.

    Labels other than 0 and 1, null ones too, are passed over; so are labels without a document. Without both
    labels the model gives each document the same score: the share of label 1 (0.5 without labels).
    """
    ok = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("label_id")))
    ok = ok.groupBy("label_id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["count"] for r in ok.groupBy("label").count().collect()}
    some = None
    for label in (0, 1):
        part = ok.where(F.col("label") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
        some = part if some is None else some.unionByName(part)
    some = stored(some, "quality-labels")  # at most 2 * sample rows
    text = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
    rows = stored(text.join(F.broadcast(some), "label_id"), "quality-sample")
    model = Model(word_vectors(neighbour_sums(docs)))
    got = rows.select("label", "text").mapInArrow(_pooled(model), "label int, x binary").collect()  # a vector a row
    x = np.array([np.frombuffer(r["x"], np.float64) for r in got]).reshape(-1, WIDTH)
    y = np.array([r["label"] for r in got], np.float64)
    del got
    order = np.lexsort((*x.T[:4], y)) if len(y) else np.arange(0)  # rows come in any order; the fit must not depend on it
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 0.5
        model.mean, model.scale = np.zeros(WIDTH), np.ones(WIDTH)
        model.w1, model.b1, model.w2 = np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1)
        model.b2 = float(np.log((p + 1e-3) / (1 - p + 1e-3)))
        return model
    model = train(model, x, y)
    odds = shares[1] / shares[0]
    model.prior = float(np.log(odds) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def _pooled(model: Model):
    vectors = model.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pool(t, vectors).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.binary())], names=["label", "x"])

    return run


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Columns row (a struct of the columns in carry, doc_id if not given) and score of every row of docs.

    A null or empty text is pooled as a text of no words and gets that vector's score. The score depends on the text
    alone, so equal texts score alike. The model (about 8 MB) goes to the executors as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.array([pool(t, m.vectors) for t in texts]).reshape(len(texts), -1)
            yield pa.record_batch([batch.column(0), pa.array(m.score(x) if len(texts) else [], pa.float64())], names=["row", "score"])

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or ["doc_id"]]).alias("row"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("score", T.DoubleType())]))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns.

    The classifier is fitted on docs and labels first; see fit and score for nulls and missing labels. Repeated rows
    are kept or dropped together, as the score depends on the text alone; an empty table gives an empty result.
    """
    return score(docs, fit(docs, labels), docs.columns).where(F.col("score") >= threshold).select("row.*")
