"""The vocabulary is exact however terms fall into buckets, and no row for each text and term is shuffled."""

import math
from collections import Counter

import pytest

from palisade.operators import linear
from palisade.plans import queries


@pytest.mark.parametrize("buckets", [4, 64, 1 << 20])
def test_vocabulary_is_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(linear, "BUCKETS", buckets)
    texts = [" ".join(f"w{i * j % (k + 3)}" for j in range(k)) for i in range(12) for k in (0, 1, 5, 9)]
    texts += ["once " * 40, "see glot.io 10.0.0.1 deadbeefdeadbeef clawhub-x two", "two"]
    docs = spark.createDataFrame([(t,) for t in texts], "content string")
    terms = [[g for g in (*w, *map(" ".join, zip(w, w[1:]))) if g] for w in (t.replace("glot.io", "").replace("10.0.0.1", "").replace("deadbeefdeadbeef", "").replace("clawhub-x", "").split() for t in texts)]
    tf, df = Counter(g for t in terms for g in t), Counter(g for t in terms for g in set(t))
    for features in (1, 5, 3000):
        want = sorted(sorted((g for g in tf if df[g] >= 2), key=lambda g: (-tf[g], g))[:features])
        got = linear.vocabulary(docs, "content", 2, features).orderBy("idx").collect()
        assert [(r.term, r.idx) for r in got] == [(g, i) for i, g in enumerate(want)]
        assert all(r.idf == pytest.approx(math.log((1 + len(texts)) / (1 + df[r.term])) + 1) for r in got)


def test_rows_with_one_key_are_one_text(spark):
    model = linear.Model(spark.createDataFrame([("cat", 0, 1.0, 1.0), ("the", 1, 2.0, -1.0)], "term string, idx int, idf double, coef double"), 0.5)
    rows = [("a", "the cat the dog"), ("a", "cat"), ("b", ""), ("c", "zzz"), ("d", None)]
    got = {r.id: r.ml_score for r in linear.predict(spark.createDataFrame(rows, "id string, t string"), model, "t", "id").collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    assert got == pytest.approx({"a": sigmoid((2 - 4) / math.sqrt(4 + 16) + 0.5), "b": 0.0, "c": sigmoid(0.5), "d": 0.0})


@pytest.mark.parametrize("name", ["linear_score", "tfidf_terms"])
def test_no_row_for_each_text_and_term_is_shuffled(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "term" in line]
