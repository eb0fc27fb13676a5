"""Corpora, CSV, folders of Markdown, sinks, streams, the linear model and the entry points."""

import gzip
import json
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palisade.functions import wordpiece
from palisade.operators import generate, linear, metrics
from palisade.plans import pipeline
from palisade.sources import tables
from palisade.streaming import stream


def test_corpora_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "n", "text é", None, "ast01"), ("b", None, "more", "malicious", None)], tables.CORPUS)
    tables.write_corpus(rows, f"{tmp_path}/c")
    got = tables.read_corpus(spark, f"{tmp_path}/c/*.gz", f"{tmp_path}/none", label="benign").collect()
    assert {(r.id, r.content, r.label, r.attack) for r in got} == {("a", "text é", "benign", "ast01"), ("b", "more", "malicious", None)}
    with gzip.open(f"{tmp_path}/x.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "z", "content": "c"}) + "\n")
    assert tables.read_corpus(spark, f"{tmp_path}/x.jsonl.gz").first().id == "z"
    assert tables.read_corpus(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("head", ["skill_name,Pattern,classification", "name,pattern,label"])
def test_bench_csv(spark, tmp_path, head):
    (tmp_path / "b.csv").write_text(f'{head}\none,"Prompt, Injection",malicious\n,YAML load,\n')
    got = [tuple(r) for r in tables.read_bench_csv(spark, f"{tmp_path}/b.csv").collect()]
    assert got == [("one", "Prompt, Injection", "malicious", "ast01"), ("", "YAML load", "", "ast05")]


def test_markdown_tree_and_its_fallback(spark, tmp_path):
    for p in ("some/skill/a.md", "other/b.md", "other/c.txt"):
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text(p)
    read = lambda like: {r.content for r in tables.read_markdown_tree(spark, f"{tmp_path}/t", like).collect()}
    assert read("/skill/") == {"some/skill/a.md"} and read("nowhere-at-all") == {"some/skill/a.md", "other/b.md"}


def test_materialised_packages_are_read_again(spark, tmp_path):
    from palisade.sources import directory

    tables.materialize(spark.createDataFrame([("p1", "# one"), ("p2", None)], "id string, content string"), str(tmp_path / "m"))
    assert {(r.skill_id, r.md) for r in directory.load_documents(spark, str(tmp_path / "m")).collect()} == {("p1", "# one"), ("p2", "")}


def test_labels_texts_and_scaffolds(spark):
    df = spark.createDataFrame([("x-pos", None, "  ", "b " * 1500), ("x-neg", None, None, "short"), ("other", None, "first", "second"), ("other", 1, "a", "b")], "config string, field int, a string, b string")
    got = df.select(tables.label_of(F.col("config"), F.col("field"), ("x-pos",), ("x-neg",)).alias("y"), tables.first_text("a", "b").alias("t"), tables.clamped(F.col("b")).alias("c"), tables.wrap_text(F.col("b"), F.col("config")).alias("w")).collect()
    assert [r.y for r in got] == [1, 0, None, 1] and [len(r.c) if r.c else None for r in got] == [2000, None, None, None]
    assert got[2].t == "first" and got[1].t == "short" and all("short" in got[1].w and r.w.startswith("---\nname:") for r in got)


def test_stream_equals_batch(spark, tmp_path):
    rows = generate.generate(spark, 25).select("id", "skill_name", "content", "label", "attack")
    rows.repartition(3).write.json(f"{tmp_path}/in")
    q = stream.start(stream.read_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    cols = ["skill_id", "verdict", "category", "evidence"]
    got = spark.read.json(f"{tmp_path}/out").select(*cols).collect()
    want = pipeline.analyze(tables.from_texts(rows, F.col("id"), F.col("content"))).select(*cols).collect()
    assert sorted(got) == sorted(want) and len(got) == 25


@pytest.fixture(scope="module")
def corpus(spark):
    bad = generate.generate(spark, 60).select("id", "skill_name", "content", "label")
    good = spark.range(60).select(F.concat(F.lit("ok-"), "id").alias("id"), F.concat(F.lit("table"), F.col("id") % 7, F.lit("-"), F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 6)).alias("skill_name"), F.concat(F.lit("prints tide tables and moon phases for harbour number "), F.col("id") % 9).alias("content"), F.lit("benign").alias("label"))
    return bad.unionByName(good).cache()


def test_linear_model_is_trained_frozen_and_loaded(spark, corpus, tmp_path):
    model = linear.train(corpus, rounds=50)
    model.save(f"{tmp_path}/m")
    again = linear.load(spark, f"{tmp_path}/m")
    a, b = ({r.id: r.ml_score for r in linear.predict(corpus, m, "content", "id").collect()} for m in (model, again))
    assert a == pytest.approx(b) and linear.load(spark, f"{tmp_path}/none") is None
    label = {r.id: r.label for r in corpus.collect()}
    assert sum((a[i] >= 0.5) == (y == "malicious") for i, y in label.items()) > 0.95 * len(label)
    empty = linear.predict(spark.createDataFrame([("e", ""), ("u", "zzzz yyyy")], "id string, content string"), model, "content", "id")
    got = {r.id: r.ml_score for r in empty.collect()}
    assert got["e"] == 0 and 0 < got["u"] < 1


def test_frozen_model_scores_as_the_fitted_one(corpus):
    assert linear.parity(corpus, rounds=50) <= 1e-9


def test_folds_keep_families_together(spark, corpus):
    folds = corpus.select(linear.family(F.col("skill_name")).alias("f"), linear.fold(F.col("skill_name")).alias("k")).distinct().collect()
    assert len(folds) == len({r.f for r in folds}) and len({r.k for r in folds}) > 2
    scores = linear.cross_validate(corpus, 3, rounds=20)
    mean = linear.summary(scores)
    assert len(scores) == 3 and mean["f1"] == pytest.approx(sum(s["f1"] for s in scores) / 3) and 0 < mean["recall"] <= 1


def test_model_scores_reach_the_verdicts(spark, corpus, tmp_path):
    docs = tables.from_texts(corpus, F.col("id"), F.col("content"))
    terms = spark.createDataFrame([("harbour", 0, 1.0, 50.0)], "term string, idx int, idf double, coef double")
    plain = {r.skill_id: r.verdict for r in pipeline.analyze_with_model(docs, None).collect()}
    pushed = {r.skill_id: r.verdict for r in pipeline.analyze_with_model(docs, linear.Model(terms, -10.0)).collect()}
    assert plain["ok-1"] == "benign" and pushed["ok-1"] == "suspicious" and all(pushed[i] == v for i, v in plain.items() if not i.startswith("ok-"))


def test_probability_is_zero_where_it_fails(spark, tmp_path):
    (tmp_path / "broken.onnx").write_bytes(b"no model")
    df = spark.createDataFrame([("a text",), (None,), ("",)], "t string")
    for model in (None, str(tmp_path / "broken.onnx"), str(tmp_path / "missing.onnx")):
        assert [r.p for r in df.select(wordpiece.injection_probability(F.col("t"), model, {"a": 0}).alias("p")).collect()] == [0.0, 0.0, 0.0]


def test_reports(spark):
    rows = spark.createDataFrame([("a", "benign", "benign"), ("b", "benign", "suspicious"), ("c", "malicious", "malicious"), ("d", "malicious", "odd")], "skill_id string, truth string, verdict string")
    text = metrics.report(metrics.half_credit(rows).first().asDict())
    assert "samples: 4 (malicious=2, benign=2)" in text and "precision=0.7500" in text
    assert [r.skill_id for r in metrics.benign_examples(rows.where("truth = 'benign'")).collect()] == ["b"]
    done = metrics.completion(rows, rows.where("skill_id <> 'a'")).first()
    assert (done.n, done.done, done.rate) == (4, 3, 0.75)


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "in/p").mkdir(parents=True)
    (tmp_path / "in/p/SKILL.md").write_text("# fine\n")
    monkeypatch.setenv("INPUT_DIR", str(tmp_path / "in"))
    monkeypatch.setenv("OUTPUT_PATH", str(tmp_path / "out"))
    assert pipeline.main([]) == 0
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["verdict"] == "benign"


def test_entry_without_the_training_data_operators(monkeypatch):
    names = set(entry.queries())
    monkeypatch.setitem(sys.modules, "palisade.llm", None)
    monkeypatch.setitem(sys.modules, "palisade.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    left = set(entry.queries())
    assert left and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in left) and left <= names and entry.oracle_sql()
