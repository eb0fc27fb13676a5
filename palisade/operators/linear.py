"""The optional linear text model: TF-IDF of words and word pairs, logistic regression, inference by a join.

A model is a table (term, idx, idf, coef) and an intercept, frozen as Parquet. Scoring looks a text's terms up in that
table (a few thousand rows) within its row; what is shuffled is the counts of known terms, one row for each text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from palisade.functions import text as tx
from palisade.functions.literals import may_match_sql, odd_cases, required

# ---- Fixed values: what the text loses before it is split, and the model's settings ----
SCRUB = (
    r"clawhub[\w-]*",
    r"clawdbot[\w-]*",
    r"\bddoy\d+\b",
    r"\bdenboss\d+\b",
    r"\bhedefbari\b",
    r"glot\.io",
    r"setup-service\.com",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"[0-9a-f]{12,}",
)
TOKEN = r"(?U)\b\w\w+\b"
NGRAM, MIN_DF, FEATURES, INVERSE_PENALTY, FOLDS = 2, 2, 3000, 4.0, 5
# ---- End of fixed values ----
#: Terms fall into so many buckets when they are counted.
BUCKETS = 1 << 20


@dataclass
class Model:
    terms: DataFrame  # term, idx, idf, coef
    intercept: float
    ngram: int = NGRAM
    scrub: tuple[str, ...] = SCRUB

    def save(self, path: str) -> None:
        self.terms.withColumn("intercept", F.lit(self.intercept)).withColumn("ngram", F.lit(self.ngram)).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model | None:
    """A saved model; None if there is none or it lacks columns, and scoring then goes by rules alone."""
    from pyspark.errors import AnalysisException

    try:
        x = spark.read.parquet(path)
    except AnalysisException:
        return None
    if not {"term", "idx", "idf", "coef", "intercept", "ngram"} <= set(x.columns):
        return None
    first = x.select("intercept", "ngram").first()
    return Model(x.select("term", "idx", "idf", "coef"), first["intercept"], first["ngram"]) if first else None


def tokens(text: Column, scrub: tuple[str, ...] = SCRUB) -> Column:
    x, named = F.lower(text), next((i for i, p in enumerate(scrub) if not required(p)), len(scrub))
    without = lambda t, ps: reduce(lambda y, p: F.regexp_replace(y, tx.FLAGS + p, " "), ps, t)
    if named:  # most texts hold no word of the first patterns
        may = F.expr("d -> " + " OR ".join(may_match_sql("d.low", p) for p in scrub[:named]))
        x = tx.let(lambda v: F.when(F.get(F.call_function("transform", F.array(F.struct(F.when(~odd_cases(v["t"]), v["t"]).alias("low"))), may), F.lit(0)), without(v["t"], scrub[:named])).otherwise(v["t"]), t=x)
    return F.regexp_extract_all(without(x, scrub[named:]), F.lit(TOKEN), F.lit(0))


def grams(toks: Column, ngram: int = NGRAM) -> Column:
    """Words and, for ngram 2, pairs of neighbours."""
    if ngram < 2:
        return toks

    def both(v: Column) -> Column:
        most = F.greatest(F.size(v["t"]) - 1, F.lit(0))
        return F.concat(v["t"], F.zip_with(F.slice(v["t"], F.lit(1), most), F.slice(v["t"], F.lit(2), most), lambda a, b: F.concat_ws(" ", a, b)))

    return tx.let(both, t=toks)


def vocabulary(docs: DataFrame, text: str, min_df: int = MIN_DF, features: int = FEATURES) -> DataFrame:
    """term, idx, idf of the terms in at least min_df texts, the most frequent first: ln((1 + n) / (1 + df)) + 1.

    Exact, by two passes that shuffle no row for each text and term. The first counts buckets of terms; no term is more
    frequent than its bucket. The second counts the terms of the fullest buckets. They hold the top terms if the last
    of these is more frequent than the fullest bucket left out; else more buckets are taken.
    """
    spark, n_docs = docs.sparkSession, docs.count()
    texts = docs.select(tx.fixed(grams(tokens(F.col(text)))).alias("t"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")
    sizes = texts.select(F.explode("t").alias("term")).groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).persist()
    # each term as often as it occurs, and once more for the text
    each = F.concat(F.transform("t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"))), F.transform(F.array_distinct("t"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"))))
    terms = texts.select(F.inline(each)).withColumn("b", bucket)
    take = 4 * features
    try:
        while True:
            fullest = sizes.orderBy(F.desc("n"), "b").limit(take + 1).collect()
            rest = fullest[take].n if len(fullest) > take else 0
            some = F.broadcast(spark.createDataFrame([(r.b,) for r in fullest[:take]], "b int"))
            counts = terms.join(some, "b", "left_semi").groupBy("term").agg(F.sum("n").alias("tf"), F.count_if(F.col("n") == 0).alias("df"))
            top = counts.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(features).collect()
            if not rest or len(top) == features and top[-1].tf > rest:
                break
            take *= 8
    finally:
        sizes.unpersist()
    rows = sorted(((r.term, r.df) for r in top), key=lambda r: r[0].encode())
    out = spark.createDataFrame([(t, i, df) for i, (t, df) in enumerate(rows)], "term string, idx int, df long")  # at most `features` rows
    return out.select("term", "idx", (F.log((F.lit(1.0) + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def _known(terms: list[str]):
    """A function from a text's terms to those known, as an array of (their place in terms, how often)."""

    @F.arrow_udf("array<struct<i:int,n:int>>")
    def known(texts: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
        at = pc.index_in(texts.flatten(), pa.array(terms, texts.type.value_type))
        there = pc.is_valid(at).to_numpy(zero_copy_only=False)
        pairs, n = np.unique(row[there] * len(terms) + at.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(terms)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(pairs % max(1, len(terms)), pa.int32()), pa.array(n, pa.int32())], ["i", "n"])
        return pa.ListArray.from_arrays(ends, values)

    return known


def _decision(idf: list[float], coef: list[float]):
    """A function from known terms, the same one several times perhaps, to the decision of the vector of length 1; null without any."""
    weight, slope = np.array(idf), np.array(coef)

    @F.arrow_udf(DoubleType())
    def decision(texts: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
        i, n = (pc.struct_field(texts.flatten(), k).to_numpy(zero_copy_only=False) for k in (0, 1))
        pairs, where = np.unique(row * len(weight) + i, return_inverse=True)
        row, i = pairs // max(1, len(weight)), pairs % max(1, len(weight))
        v = np.bincount(where, n, len(pairs)) * weight[i]
        dot, square = np.bincount(row, v * slope[i], len(texts)), np.bincount(row, v * v, len(texts))
        return pa.array(dot / np.sqrt(np.where(square > 0, square, 1)), mask=square <= 0)

    return decision


def predict(docs: DataFrame, model: Model, text: str = "all_text", key: str = "skill_id") -> DataFrame:
    """key, ml_score: the logistic of the L2-normalised TF-IDF's decision; without known terms that of the intercept; 0 for an empty text.

    Rows that share a key count as one text.
    """
    rows = model.terms.select("term", F.col("idf").cast("double"), F.col("coef").cast("double")).collect()  # a few thousand rows
    terms, idf, coef = zip(*rows, strict=True) if rows else ((), (), ())
    x = docs.select(key, tx.fixed(grams(tokens(F.col(text), model.scrub), model.ngram)).alias("t")).select(key, _known(list(terms))(F.col("t")).alias("v"))
    x = x.groupBy(key).agg(F.collect_list("v").alias("v")).select(key, tx.fixed(F.flatten("v")).alias("v")).select(key, _decision(idf, coef)(F.col("v")).alias("d"))
    y = docs.select(key, (F.coalesce(F.col(text), F.lit("")) == "").alias("none")).join(x, key, "left")
    return y.select(key, F.when(F.col("none"), 0.0).otherwise(tx.sigmoid(F.coalesce("d", F.lit(0.0)) + model.intercept)).alias("ml_score"))


def family(name: Column) -> Column:
    """The group of near-equal packages: the name without a random suffix and a trailing number."""
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[-_][0-9a-z]{3,8}\z", "")
    bare = F.regexp_replace(low, r"\d+\z", "")
    return F.when(bare != "", bare).when(F.coalesce(name, F.lit("")) != "", name).otherwise("x")


def fold(name: Column, folds: int = FOLDS) -> Column:
    """The fold of a package's family: a family is never split."""
    return F.pmod(F.xxhash64(family(name)), F.lit(folds)).cast("int")


def _vectors(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, y, features: sparse vectors of length 1, of the terms of a text that are in the vocabulary."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    terms = vocab.orderBy("idx").select("term", "idf").collect()  # at most `features` rows
    counts = CountVectorizerModel.from_vocabulary([t.term for t in terms] or ["\x00"], "terms", "counts")
    weights = ElementwiseProduct(scalingVec=Vectors.dense([t.idf for t in terms] or [0.0]), inputCol="counts", outputCol="raw")
    x = docs.select("id", (F.lower(F.coalesce("label", F.lit(""))) == "malicious").cast("double").alias("y"), grams(tokens(F.coalesce("content", F.lit("")))).alias("terms"))
    return Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(weights.transform(counts.transform(x))).select("id", "y", "features")


def _fit(rows: DataFrame, rounds: int):
    from pyspark.ml.classification import LogisticRegression

    n, pos = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    weight = F.when(F.col("y") == 1, n / (2 * max(pos, 1.0))).otherwise(n / (2 * max(n - pos, 1.0)))
    lr = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / (INVERSE_PENALTY * n), elasticNetParam=0.0, standardization=False, maxIter=rounds)
    return lr.fit(rows.withColumn("w", weight))


def train(docs: DataFrame, min_df: int = MIN_DF, features: int = FEATURES, rounds: int = 200) -> Model:
    """Fit on all of docs (id, content, label) and freeze. The model, a few thousand rows, is made on the driver."""
    return _trained(docs, min_df, features, rounds)[0]


def _trained(docs: DataFrame, min_df: int, features: int, rounds: int):
    spark = docs.sparkSession
    top = vocabulary(docs, "content", min_df, features).orderBy("idx").collect()  # at most `features` rows
    vocab = spark.createDataFrame([tuple(t) for t in top], "term string, idx int, idf double")
    vectors = _vectors(docs, vocab).persist()
    try:
        fitted = _fit(vectors, rounds)
    finally:
        vectors.unpersist()
    rows = [(t.term, t.idx, t.idf, float(c)) for t, c in zip(top, fitted.coefficients.toArray(), strict=False)]
    return Model(spark.createDataFrame(rows, "term string, idx int, idf double, coef double"), float(fitted.intercept)), fitted, vocab


def parity(docs: DataFrame, min_df: int = MIN_DF, features: int = FEATURES, rounds: int = 200) -> float:
    """The largest difference, over docs, between the frozen model's score by a join and the fitted pipeline's own probability."""
    model, fitted, vocab = _trained(docs, min_df, features, rounds)
    from pyspark.ml.functions import vector_to_array

    own = fitted.transform(_vectors(docs, vocab)).select("id", vector_to_array("probability")[1].alias("p"))
    both = predict(docs.where("content <> ''"), model, "content", "id").join(own, "id")
    return both.agg(F.max(F.abs(F.col("ml_score") - F.col("p")))).first()[0] or 0.0


def cross_validate(docs: DataFrame, folds: int = FOLDS, **settings) -> list[dict]:
    """Precision, recall and F1 of each fold; families stay together. docs also has skill_name."""
    out = []
    x = docs.withColumn("fold", fold(F.col("skill_name"), folds)).persist()
    try:
        for k in range(folds):
            model = train(x.where(F.col("fold") != k), **settings)
            test = x.where(F.col("fold") == k)
            p = predict(test, model, "content", "id").join(test.select("id", "label"), "id")
            hit, said, real = p.agg(F.count_if((F.col("ml_score") >= 0.5) & (F.col("label") == "malicious")), F.count_if(F.col("ml_score") >= 0.5), F.count_if(F.col("label") == "malicious")).first()
            precision, recall = hit / said if said else 0.0, hit / real if real else 0.0
            out.append({"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if hit else 0.0})
    finally:
        x.unpersist()
    return out


def summary(scores: list[dict]) -> dict:
    """The mean of each measure over the folds."""
    return {k: sum(s[k] for s in scores) / len(scores) for k in ("precision", "recall", "f1")} if scores else {}
