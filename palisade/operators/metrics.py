"""Evaluation: confusion matrices, F-scores under two rules, category accuracy, sweeps, checks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import catalogue as C
from palisade.operators.score import judge, weigh

VERDICTS = ("benign", "suspicious", "malicious")
CREDIT = {"malicious": 1.0, "suspicious": 0.5, "benign": 0.0}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def verdict_or_suspicious(v: Column) -> Column:
    return F.when(v.isin(*VERDICTS), v).otherwise("suspicious")


def confusion(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each pair of truth and verdict, in long form: by..., truth, verdict, n."""
    return pairs.withColumn("verdict", verdict_or_suspicious(F.col("verdict"))).groupBy(*by, "truth", "verdict").agg(F.count(F.lit(1)).alias("n"))


def _cells(pairs: DataFrame, by: tuple[str, ...], truths: tuple[str, ...], *more: Column) -> DataFrame:
    """One row for each group: a column t_v with the count of truth t and verdict v, and more aggregates."""
    v = verdict_or_suspicious(F.col("verdict"))
    return pairs.groupBy(*by).agg(*[F.count_if((F.col("truth") == t) & (v == p)).alias(f"{t}_{p}") for t in truths for p in VERDICTS], *more)


def half_credit(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Two-class metrics; suspicious counts half on either side. truth other than malicious is benign."""
    x = _cells(pairs.withColumn("truth", F.when(F.col("truth") == "malicious", "malicious").otherwise("benign")), by, ("malicious", "benign"))
    c = F.col
    tp, fn = c("malicious_malicious") + 0.5 * c("malicious_suspicious"), c("malicious_benign") + 0.5 * c("malicious_suspicious")
    fp, tn = c("benign_malicious") + 0.5 * c("benign_suspicious"), c("benign_benign") + 0.5 * c("benign_suspicious")
    x = x.withColumns({"tp": tp, "fp": fp, "fn": fn, "tn": tn})
    x = x.withColumns({"precision": _ratio(c("tp"), c("tp") + c("fp")), "recall": _ratio(c("tp"), c("tp") + c("fn")), "specificity": _ratio(c("tn"), c("tn") + c("fp"))})
    x = x.withColumns({"f1": _ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")), "f2": _ratio(5 * c("precision") * c("recall"), 4 * c("precision") + c("recall"))})
    n = lambda t: sum(c(f"{t}_{v}") for v in VERDICTS)
    x = x.withColumns({"n_malicious": n("malicious"), "n_benign": n("benign"), "n_total": n("malicious") + n("benign")})
    rounded = [F.round(k, 4).alias(k) for k in ("tp", "fp", "fn", "tn", "precision", "recall", "specificity", "f1", "f2")]
    return x.select(*by, "n_total", "n_malicious", "n_benign", *[f"{t}_{v}" for t in ("malicious", "benign") for v in VERDICTS], *rounded)


def f2(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return _ratio(5 * p * r, 4 * p + r), p, r


def two_rules(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F2 where only malicious is positive (a) and where suspicious is positive too (b), and benign specificity."""
    return _two_rules(_cells(pairs, by, VERDICTS), *by)


def _two_rules(x: DataFrame, *keep: str | Column) -> DataFrame:
    c = F.col
    fa, pa, ra = f2(c("malicious_malicious"), c("benign_malicious"), c("malicious_benign") + c("malicious_suspicious"))
    tb = c("malicious_malicious") + c("malicious_suspicious") + c("suspicious_malicious") + c("suspicious_suspicious")
    fb, pb, rb = f2(tb, c("benign_malicious") + c("benign_suspicious"), c("malicious_benign") + c("suspicious_benign"))
    n = c("benign_benign") + c("benign_suspicious") + c("benign_malicious")
    spec = F.when(n > 0, c("benign_benign") / n).otherwise(1.0)
    return x.select(*keep, fa.alias("f2_a"), pa.alias("precision_a"), ra.alias("recall_a"), fb.alias("f2_b"), pb.alias("precision_b"), rb.alias("recall_b"), spec.alias("specificity"))


def _judged_positive() -> Column:
    return F.col("truth").isin("malicious", "suspicious") & (F.col("truth_category") != "") & F.col("verdict").isin("malicious", "suspicious")


def category_accuracy(rows: DataFrame) -> DataFrame:
    """attack, hits, total over (truth, truth_category, verdict, category): of the positives with a label that were judged positive."""
    return rows.where(_judged_positive()).groupBy(F.col("truth_category").alias("attack")).agg(F.count_if(F.col("category") == F.col("truth_category")).alias("hits"), F.count(F.lit(1)).alias("total"))


def credit(verdict: Column) -> Column:
    return F.when(verdict == "malicious", 1.0).when(verdict == "suspicious", 0.5).otherwise(0.0)


def recall_by_attack(rows: DataFrame) -> DataFrame:
    """attack ("real" if null), n, recall with half credit, missed."""
    return rows.groupBy(F.coalesce("attack", F.lit("real")).alias("attack")).agg(F.count(F.lit(1)).alias("n"), F.avg(credit(F.col("verdict"))).alias("recall"), F.count_if(F.col("verdict") == "benign").alias("missed"))


def false_positive_signals(rows: DataFrame) -> DataFrame:
    """id, n: how often each signal fired in benign rows that were not judged benign."""
    return rows.where((F.col("truth") == "benign") & (F.col("verdict") != "benign")).select(F.explode("fired").alias("s")).groupBy(F.col("s.id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def benign_examples(rows: DataFrame, most: int = 15) -> DataFrame:
    """The first rows, by skill_id, that were not judged benign: a report's examples."""
    return rows.where("verdict <> 'benign'").orderBy("skill_id").limit(most)


def completion(expected: DataFrame, written: DataFrame) -> DataFrame:
    """n, done, rate: how many of the packages have a result."""
    x = expected.select("skill_id").join(written.select("skill_id").distinct().withColumn("_w", F.lit(1)), "skill_id", "left")
    x = x.agg(F.count(F.lit(1)).alias("n"), F.count("_w").alias("done"))
    return x.withColumn("rate", _ratio(F.col("done").cast("double"), F.col("n").cast("double")))


def benign_report(rows: DataFrame) -> DataFrame:
    """n, full- and half-credit specificity and the false-positive rate over benign rows."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("verdict") == "benign").cast("double")).alias("specificity"),
        F.avg(1 - credit(F.col("verdict"))).alias("half_specificity"),
        F.avg((F.col("verdict") == "malicious").cast("double")).alias("false_positive_rate"),
    )


def projected_total(rows: DataFrame) -> DataFrame:
    """The overall mark out of 10 under either rule, with full marks for speed and robustness, over rows as for category_accuracy; they are read once."""
    hit = _judged_positive() & (F.col("category") == F.col("truth_category"))
    x = _cells(rows, (), VERDICTS, F.count_if(hit).alias("hits"), F.count_if(_judged_positive()).alias("total"))
    mark = lambda f: 10 * (0.55 * F.col(f) + 0.10 + 0.20 * F.col("accuracy") + 0.15)
    return _two_rules(x, _ratio(F.col("hits"), F.col("total")).alias("accuracy")).select(mark("f2_a").alias("total_a"), mark("f2_b").alias("total_b"))


def verdict_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def category_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("benign")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def grid(spark, benign: tuple[int, ...], malicious: tuple[int, ...]) -> DataFrame:
    """All pairs of band limits, as a table of a few rows."""
    pairs = ", ".join(f"({b}, {m})" for b in benign for m in malicious if m > b)
    return spark.sql(f"SELECT * FROM VALUES {pairs} AS g(benign_max, mal_min)")


#: What a row needs to be judged again under other limits.
JUDGED_BY = ("r0", "analytic", "confirmed", "infra", "mismatch")


def reband(base: DataFrame, limits: DataFrame, keep: tuple[str, ...] = ("truth",)) -> DataFrame:
    """Every row of base (scan's output and `keep`) under every pair of limits: scanned and weighed once, judged for each pair.

    Floor, cap and promotion move with the limits. The limits are a few dozen rows; what they are joined to is five
    small columns, not the texts.
    """
    x = weigh(base).select(*keep, *JUDGED_BY)
    return judge(x.join(F.broadcast(limits), how="cross"), thresholds=(F.col("benign_max"), F.col("mal_min")))


def sweep(scored: DataFrame) -> DataFrame:
    """The blended objective of half-credit metrics for each pair of limits (benign_max, mal_min, truth, verdict), best first."""
    m = half_credit(scored, ("benign_max", "mal_min"))
    w = C.SWEEP_WEIGHTS
    gray = 1 - F.abs(F.col("benign_suspicious") - F.col("malicious_suspicious")) / F.greatest(F.lit(1), F.col("n_total"))
    obj = F.round(w["f2"] * F.col("f2") + w["specificity"] * F.col("specificity") + w["gray_handling"] * gray, 4)
    return m.select("benign_max", "mal_min", "f2", "specificity", "recall", "precision", obj.alias("objective")).orderBy(F.desc("objective"), "benign_max", "mal_min")


def calibrate(scored: DataFrame) -> DataFrame:
    """0.5 F2 (rule a) + 0.3 F2 (rule b) + 0.2 specificity for each pair of limits, best first."""
    m = two_rules(scored, ("benign_max", "mal_min"))
    obj = 0.5 * F.col("f2_a") + 0.3 * F.col("f2_b") + 0.2 * F.col("specificity")
    return m.select("benign_max", "mal_min", "f2_a", "f2_b", "specificity", obj.alias("objective")).orderBy(*[F.desc(c) for c in ("objective", "f2_a", "f2_b", "specificity", "benign_max", "mal_min")])


def schema_problems(results: DataFrame) -> DataFrame:
    """Counts of results that break the output's rules, one column for each rule."""
    ok_category = F.col("category").isin("AST01", "AST02", "AST03", "AST04", "AST05", "AST06", "AST07", "AST08", "AST10", "")
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("verdict").isin(*VERDICTS) | F.col("verdict").isNull()).alias("bad_verdict"),
        F.count_if(~F.col("confidence").between(0.0, 1.0) | F.col("confidence").isNull()).alias("bad_confidence"),
        F.count_if(~ok_category | F.col("category").isNull()).alias("bad_category"),
        F.count_if(F.coalesce(F.trim("evidence"), F.lit("")) == "").alias("empty_evidence"),
    )


def fingerprint(results: DataFrame, *columns: str) -> DataFrame:
    """n and an order-free digest of the rows: two runs agree exactly if both do."""
    row = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns or results.columns])
    return results.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("long")).alias("digest"))


def reconcile(expected: DataFrame, written: DataFrame) -> DataFrame:
    """skill_ids that are on one side only: skill_id, missing, surplus."""
    a, b = expected.select("skill_id", F.lit(True).alias("_e")), written.select("skill_id", F.lit(True).alias("_w"))
    return a.join(b, "skill_id", "full_outer").where("_e IS NULL OR _w IS NULL").select("skill_id", F.col("_w").isNull().alias("missing"), F.col("_e").isNull().alias("surplus"))


def report(spark_row: dict) -> str:
    """A metrics row as lines for people."""
    r = spark_row
    lines = [f"samples: {r['n_total']} (malicious={r['n_malicious']}, benign={r['n_benign']})", "", "truth       benign  suspicious  malicious"]
    lines += [f"{t:<10} {r[f'{t}_benign']:7d} {r[f'{t}_suspicious']:11d} {r[f'{t}_malicious']:10d}" for t in ("malicious", "benign")]
    lines += ["", " ".join(f"{k}={r[k]:.4f}" for k in ("precision", "recall", "specificity", "f1", "f2"))]
    return "\n".join(lines)
