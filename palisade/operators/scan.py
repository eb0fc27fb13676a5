"""Scanning: documents to fired signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import hints, manifests
from palisade.functions import text as tx
from palisade.functions.literals import quoted
from palisade.operators import catalogue as C

MARKS = {m.id: m for m in (*C.RULES, *C.OTHER_MARKS, *C.MANIFEST_MARKS)}
#: The tests of `hints` that stand before costly patterns: those of the manifest signals, these, and one for each rule. MIXED: a letter from U+0370 to U+04FF.
TESTS = (*manifests.TESTS, ("(?i)" + hints.any_of(C.SECURITY_WORDS),), ("(?i)" + hints.any_of(C.DEFI_WORDS),), (hints.loosened(tx.BASE64_RUN),), (r"\xCD[\xB0-\xBF]|[\xCE-\xD3]",), (hints.loosened(C.PRIMITIVE),))
SECURITY, DEFI, RUN, MIXED, PRIMITIVE = range(len(manifests.TESTS), len(TESTS))
SIGNAL = "struct<ord:int,id:string,weight:int,tier:string,category:string,snippet:string>"


def _rule_sql(rule: C.Rule, i: int) -> str:
    """The matched text of a rule, the i-th, null where it does not hold; over a look."""
    text, i = f"d.{rule.scope}", len(TESTS) + i
    may, tail = hints.may_sql("d.at", i), hints.tail_sql(text, "d.at", i)
    if rule.scope != "all":  # the places are those of the whole text
        may, tail = f"({may} OR NOT startswith(d.whole, {text}))", f"if(startswith(d.whole, {text}), {tail}, {text})"
    found = tx.first_sql(tail, rule.pattern) if rule.near is None else f"get(transform(array({tail}), t -> {tx.near_sql('t', rule.pattern, rule.near, rule.window)}), 0)"
    return f"if({may}, {found}, null)"


def scope_text(rule: C.Rule) -> Column:
    return F.col({"md": "md", "code": "code"}.get(rule.scope, "all_text"))


def _mark_sql(id_: str) -> str:
    m = MARKS[id_]
    return f"'id', {quoted(id_)}, 'weight', {m.weight}, 'tier', {quoted(m.tier)}, 'category', {quoted(m.category)}"


def _present(base: int, signals: list[tuple[str, Column]]) -> Column:
    """Those of (id, snippet) whose snippet is not null, as signals numbered from base."""
    all_ = ", ".join(f"named_struct('ord', {base + i}, {_mark_sql(k)}, 'snippet', d.c{i})" for i, (k, _) in enumerate(signals))
    return tx.over(f"filter(array({all_}), s -> s.snippet IS NOT NULL)", **{f"c{i}": c for i, (_, c) in enumerate(signals)})


def _rules_over(rules: tuple[C.Rule, ...], looks: Column) -> Column:
    """The rules that fire, for each of `looks`: structs of base, places, the whole text and the texts of the scopes."""
    one = ", ".join(f"named_struct('ord', d.base + {i}, {_mark_sql(r.id)}, 'snippet', {tx.collapse_sql(_rule_sql(r, i))})" for i, r in enumerate(rules))
    return F.flatten(F.call_function("transform", looks, F.expr(f"d -> filter(array({one}), s -> s.snippet IS NOT NULL)")))


def _look(rules: tuple[C.Rule, ...], base: int, at: Column, text: Column | None = None) -> Column:
    scopes = {r.scope: scope_text(r) if text is None else text for r in rules}
    whole = F.col("all_text") if text is None else text
    return F.struct(F.lit(base).alias("base"), at.alias("at"), whole.alias("whole"), *[t.alias(k) for k, t in scopes.items()])


def _tests(rules: tuple[C.Rule, ...]) -> tuple[tuple[str | None, ...], ...]:
    return TESTS + tuple(tuple(hints.loosened(p) for p in (r.pattern, r.near) if p is not None) for r in rules)


def other_signals() -> list[tuple[str, Column]]:
    """(id, snippet) of the signals that no catalogue pattern gives, in order."""
    at = F.col("at")
    run, runs = hints.may(at, RUN), hints.tail(F.col("all_text"), at, RUN)
    blob = F.when(run, tx.let(lambda v: tx.entropy_blob(v["t"], C.BLOB_MIN_CHARS, C.BLOB_MIN_BITS), t=runs))
    token = F.col("_mixed")
    hidden = tx.let(lambda v: F.get(F.filter(F.transform(tx.decoded(v["t"]), lambda t: tx.first_match(t, C.PRIMITIVE)), lambda m: m.isNotNull()), F.lit(0)), t=runs)
    inner = tx.first_match(F.col("code"), C.PRIMITIVE)  # most packages have little code, so it is looked at first
    outer = F.when(F.startswith("all_text", "md"), F.when(hints.may(at, PRIMITIVE), hints.tail(F.col("md"), at, PRIMITIVE)).otherwise("")).otherwise(F.col("md"))
    split = F.when(inner.isNotNull() & ~tx.has_match(outer, C.PRIMITIVE), inner)
    return [
        ("S_zero_width", F.when(F.col("has_zero_width"), F.lit("(invisible characters)"))),
        ("S_high_entropy_blob", F.when(F.length(blob) > 40, F.concat(F.substring(blob, 1, 40), F.lit("…"))).otherwise(blob)),
        ("S_bundled_binary", F.when(F.size("bundled_binaries") > 0, F.array_join(F.slice("bundled_binaries", 1, 3), ", "))),
        ("S_split_logic", tx.collapse_ws(split)),
        ("S_homoglyph", F.substring(tx.collapse_ws(token), 1, 60)),
        ("S_decoded_payload", F.substring(tx.collapse_ws(F.when(run, hidden)), 1, 60)),
    ]


def scan(docs: DataFrame, rules: tuple[C.Rule, ...] = C.RULES) -> DataFrame:
    """docs with `fired`, the array of signals in order; a signal may occur twice (see dedupe in score). `at`: the places of TESTS.

    Order: the catalogue, zero width, blob, binaries, split logic, mixed scripts, the catalogue again on the text
    with look-alike letters replaced (only where mixed scripts fired), decoded payload, manifest signals. The catalogue
    stands in the plan once and goes over both texts.
    """
    n = len(rules)
    tests = _tests(rules)
    x = docs.withColumn("at", hints.places(F.col("all_text"), tests, (tx.CONFUSABLE_FROM, tx.CONFUSABLE_TO)))
    x = x.withColumn("_mixed", tx.fixed(F.when(hints.may(F.col("at"), MIXED), tx.mixed_script_token(F.col("all_text")))))
    plain = F.when(F.size("at") > len(tests), F.slice("at", len(tests) + 1, len(tests))).otherwise(F.col("at"))
    look = _look(rules, 0, F.col("at"))
    looks = F.when(F.col("_mixed").isNull(), F.array(look)).otherwise(F.array(look, _look(rules, n + 10, plain, tx.deconfuse(F.col("all_text")))))
    x = x.withColumn("_rules", _rules_over(rules, looks))
    others = other_signals()
    late = [*others[5:], *manifests.signals({"manifest": F.col("manifest"), "all_text": F.col("all_text"), "at": F.col("at")})]
    rest = F.concat(_present(n, others[:5]), _present(2 * n + 20, late))
    x = x.withColumn("fired", tx.fixed(F.array_sort(F.concat("_rules", rest))))
    return x.drop("_mixed", "_rules")


def long_signals(scanned: DataFrame) -> DataFrame:
    """One row per fired signal: skill_id, ord, id, weight, tier, category, snippet."""
    return scanned.select("skill_id", F.inline("fired"))


def rules_table(spark) -> DataFrame:
    """The catalogue as a dimension: id, weight, tier, category (38 rows, for broadcast joins)."""
    return spark.createDataFrame([(m.id, m.weight, m.tier, m.category) for m in MARKS.values()], "id string, weight int, tier string, category string")


def near_pairs(docs: DataFrame, rule: C.Rule) -> DataFrame:
    """All pairs of places of a co-occurrence rule within its window: skill_id, a_start, b_start, match.

    The relational form of near_match. Both sides are cut into cells as wide as the window, so that the range join is
    an equality join on (skill_id, cell) followed by a check.
    """
    text = scope_text(rule)
    some = docs.where(tx.has_match(text, rule.pattern) & tx.has_match(text, rule.near)).select("skill_id", text.alias("t"))
    a = some.select("skill_id", F.inline(tx.match_places(F.col("t"), rule.pattern))).withColumnRenamed("start", "a_start")
    b = some.select("skill_id", F.inline(tx.match_places(F.col("t"), rule.near))).select("skill_id", F.col("start").alias("b_start"))
    w = max(1, rule.window or C.MAX_SCAN_CHARS)
    a = a.withColumn("cell", F.explode(F.array(*[F.floor(F.col("a_start") / w) + k for k in (-1, 0, 1)])))
    b = b.withColumn("cell", F.floor(F.col("b_start") / w))
    return a.join(b, ["skill_id", "cell"]).where(F.abs(F.col("a_start") - F.col("b_start")) <= w).select("skill_id", "a_start", "b_start", "match")
