"""Scoring: fired signals to verdict, category, confidence and evidence, as one chain of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import hints
from palisade.functions import text as tx
from palisade.functions.literals import quoted
from palisade.operators import catalogue as C
from palisade.operators.scan import DEFI, SECURITY, SIGNAL

# ---- Fixed values ----
STRONG_CAPABILITY = (
    "S_reverse_shell", "S_decode_pipe_shell", "S_decode_exec_call", "S_cred_harvest_egress", "S_cmd_output_exfil",
    "S_data_exfil_instruction", "S_decoded_payload", "S_pipe_to_shell", "S_external_binary_run",
)
HARMLESS_WORDS = (
    "format", "convert", "lint", "style", "note", "todo", "markdown", "summar", "translat", "spell", "grammar", "emoji",
    "color", "theme", "template", "snippet", "calendar", "reminder", "weather", "unit", "todo", "wallpaper",
)
SECURITY_TRADE = (
    "security", "forensic", "malware", "pentest", "penetration", "exploit", "reverse engineer", "incident", "threat",
    "red team", "blue team", "ctf", "sandbox", "honeypot", "yara", "detection", "audit",
)
PASTE_HOSTS = ("glot.io", "rentry", "pastebin", "0x0.st", "transfer.sh", "vercel.app", "glitch.me", "repl.co", "workers.dev", "anonfiles")
SATURATED_AT = 90
# ---- End of fixed values ----


_strings = tx.strings


def _table(pairs: dict[str, str]) -> Column:
    """A constant map, in one call."""
    return F.expr(f"map({', '.join(quoted(x) for kv in pairs.items() for x in kv)})")


def _none() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def ids(fired: Column) -> Column:
    return F.transform(fired, lambda s: s["id"])


def dedupe(fired: Column) -> Column:
    """The first of each id, in order."""
    return F.aggregate(fired, _none(), lambda acc, s: F.when(F.exists(acc, lambda t: t["id"] == s["id"]), acc).otherwise(F.concat(acc, F.array(s))))


def droppable(fired: Column) -> Column:
    """Ids of signals that an innocent reading explains: a private address, an official domain."""
    def one(s: Column) -> Column:
        low = F.lower(s["snippet"])
        private = (s["id"] == "S_ip_literal_url") & tx.starts_with_any(low, C.PRIVATE_PREFIXES)
        official = (s["id"] == "S_paste_host") & tx.contains_any(low, C.OFFICIAL_DOMAINS) & ~tx.contains_any(low, PASTE_HOSTS)
        return private | official

    return ids(F.filter(fired, one))


def severity(category: Column, other: int) -> Column:
    at = F.array_position(_strings(C.SEVERITY), category)
    return F.when(at > 0, at - 1).otherwise(F.lit(other)).cast("int")


def ranked(fired: Column) -> Column:
    """Heaviest first, then most severe, then by id."""
    keyed = F.transform(fired, lambda s: F.struct((-s["weight"]).alias("w"), severity(s["category"], 99).alias("r"), s["id"].alias("id"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def band(r: Column, benign: Column | int = C.BENIGN_BELOW, malicious: Column | int = C.MALICIOUS_FROM) -> Column:
    return F.when(r >= malicious, "malicious").when(r >= benign, "suspicious").otherwise("benign")


def suppress(scanned: DataFrame) -> DataFrame:
    """Adds analytic (a security tool's context), penalty, notes, kept (the signals left, one of each)."""
    words = lambda test, some: hints.may(F.col("at"), test) & tx.let(lambda v: tx.contains_any(v["low"], some), low=F.lower(hints.tail(F.col("all_text"), F.col("at"), test)))
    confirmed = F.arrays_overlap(ids(F.col("fired")), _strings(C.CONFIRMED))
    x = scanned.withColumn("analytic", tx.fixed(words(SECURITY, C.SECURITY_WORDS))).withColumn("_trade", tx.fixed(words(DEFI, C.DEFI_WORDS))).withColumn("_confirmed", confirmed)
    calm = ~F.col("_confirmed")
    penalty = F.when(F.col("_trade") & calm, C.DEFI_PENALTY).otherwise(0) + F.when(F.col("analytic") & calm, C.SECURITY_PENALTY).otherwise(0)
    notes = F.filter(F.array(F.when(F.col("_trade") & calm, F.lit(C.DEFI_NOTE)), F.when(F.col("analytic") & calm, F.lit(C.SECURITY_NOTE))), lambda n: n.isNotNull())
    drop = droppable(F.col("fired"))
    kept = dedupe(F.filter("fired", lambda s: ~F.array_contains(F.col("_drop"), s["id"])))
    x = x.withColumn("penalty", penalty).withColumn("notes", notes).withColumn("_drop", drop).withColumn("kept", tx.fixed(kept))
    return x.drop("_trade", "_confirmed", "_drop", "at")


def weigh(scanned: DataFrame) -> DataFrame:
    """What does not depend on the band limits: synergy, r0 (the clamped sum), confirmed, infra, mismatch, besides what suppress adds."""
    x = suppress(scanned)
    kept = F.col("kept")
    total = F.aggregate(kept, F.lit(0), lambda a, s: a + s["weight"])
    tiers = F.size(F.array_distinct(F.filter(F.transform(kept, lambda s: s["tier"]), lambda t: t.isin(*C.SYNERGY_TIERS))))
    x = x.withColumn("synergy", tiers >= 2)
    r0 = F.greatest(F.lit(0), F.least(F.lit(100), total + F.when(F.col("synergy"), C.SYNERGY_BONUS).otherwise(0) - F.col("penalty")))
    about = F.trim(F.lower(F.concat_ws(" ", "manifest.description", "manifest.name")))
    mismatch = F.arrays_overlap(ids(kept), _strings(STRONG_CAPABILITY)) & tx.contains_any(about, HARMLESS_WORDS) & ~tx.contains_any(about, SECURITY_TRADE)
    flags = {"confirmed": F.arrays_overlap(ids(kept), _strings(C.CONFIRMED)), "infra": F.arrays_overlap(ids(kept), _strings(C.STRONG_INFRASTRUCTURE)), "mismatch": mismatch}
    return x.withColumn("r0", tx.fixed(r0.cast("int"))).withColumns({k: tx.fixed(v) for k, v in flags.items()})


def judge(weighed: DataFrame, fast: bool = False, model_score: Column | None = None, prose_score: Column | None = None, thresholds: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds r, verdict, ml_score, ml_boosted, semantic_boosted and capped to weigh()'s r0, analytic, confirmed, infra and mismatch."""
    benign, malicious = thresholds or (F.lit(C.BENIGN_BELOW), F.lit(C.MALICIOUS_FROM))
    infra = F.col("infra")
    x = weighed.withColumn("r", F.when(F.col("confirmed") & (F.col("r0") < malicious), malicious).otherwise(F.col("r0")))
    x = x.withColumn("capped", F.col("analytic") & (F.col("r") >= malicious) & ~infra)
    x = x.withColumn("r", F.when(F.col("capped"), malicious - 1).otherwise(F.col("r")).cast("int"))
    x = x.withColumn("verdict", band(F.col("r"), benign, malicious)).withColumn("ml_score", F.lit(0.0) if model_score is None else F.coalesce(model_score, F.lit(0.0)))
    x = x.withColumn("ml_boosted", (F.col("ml_score") >= C.MODEL_BOOST_FROM) & (F.col("verdict") != "malicious"))
    x = x.withColumn("verdict", F.when(F.col("ml_boosted"), F.when(F.col("verdict") == "benign", "suspicious").otherwise("malicious")).otherwise(F.col("verdict")))
    x = x.withColumn("_clamped", F.col("analytic") & (F.col("verdict") == "malicious") & ~infra)
    x = x.withColumn("verdict", F.when(F.col("_clamped"), "suspicious").otherwise(F.col("verdict"))).withColumn("ml_boosted", F.col("ml_boosted") & ~F.col("_clamped"))
    prose = F.lit(False) if prose_score is None else F.coalesce(prose_score, F.lit(0.0)) >= C.PROSE_MODEL_FROM
    promoted = F.lit(False) if fast else (F.col("verdict") == "suspicious") & (F.col("mismatch") | prose)
    x = x.withColumn("semantic_boosted", promoted)
    return x.withColumn("verdict", F.when(F.col("semantic_boosted"), "malicious").otherwise(F.col("verdict"))).drop("_clamped")


def score(scanned: DataFrame, fast: bool = False, model_score: Column | None = None, prose_score: Column | None = None, thresholds: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds r, verdict, ml_score, synergy, ml_boosted, semantic_boosted, notes and fired in ranked order.

    fast: without the mismatch step. model_score: probability of a text model (0 without one). prose_score: that of a
    prose-injection model. thresholds: columns to use for the two band limits.
    """
    x = judge(weigh(scanned), fast, model_score, prose_score, thresholds)
    x = x.withColumn("r", tx.fixed(F.col("r"))).withColumn("verdict", tx.fixed(F.col("verdict")))
    x = x.withColumn("notes", F.when(F.col("capped") & ~F.array_contains("notes", C.SECURITY_NOTE), F.concat("notes", F.array(F.lit(C.SECURITY_NOTE)))).otherwise(F.col("notes")))
    return x.withColumn("fired", ranked(F.col("kept"))).drop("kept", "capped", "r0", "confirmed", "infra", "mismatch")


def category(verdict: Column, fired: Column) -> Column:
    """The category of the heaviest signal (then most severe, then by id), ast09 passed over."""
    some = F.filter(fired, lambda s: s["category"] != "ast09")
    keyed = F.transform(some, lambda s: F.struct((-s["weight"]).alias("w"), severity(s["category"], 998).alias("r"), s["id"].alias("id"), s["category"].alias("c")))
    return F.when(verdict == "benign", "benign").otherwise(F.coalesce(F.array_min(keyed)["c"], F.lit(C.DEFAULT_CATEGORY)))


def category_label(category: Column) -> Column:
    return F.when(F.lower(F.substring(category, 1, 3)) == "ast", F.upper(category)).otherwise("")


def confidence(verdict: Column, r: Column, ml_boosted: Column) -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    high = 0.60 + 0.39 * unit((r - C.MALICIOUS_FROM) / float(max(1, SATURATED_AT - C.MALICIOUS_FROM)))
    low = 0.55 + 0.40 * unit((C.BENIGN_BELOW - r) / float(max(1, C.BENIGN_BELOW)))
    c = F.when(verdict == "malicious", high).when(verdict == "benign", low).otherwise(F.lit(0.45))
    c = F.when(ml_boosted & (verdict != "benign"), F.greatest(c, F.lit(0.65))).otherwise(c)
    return F.round(unit(c), 3)


def clause(signal: Column, table: Column) -> Column:
    """A signal's sentence around its quoted snippet; table: the sentences by id."""
    t = F.regexp_replace(signal["snippet"], r"(?U)\A\s+|\s+\z", "")
    t = F.when(F.length(t) > C.SNIPPET_CHARS, F.concat(F.substring(t, 1, C.SNIPPET_CHARS), F.lit("…"))).otherwise(t)
    return F.replace(F.coalesce(F.try_element_at(table, signal["id"]), F.lit(C.OTHER_TEMPLATE)), F.lit("{snip}"), F.concat(F.lit("「"), t, F.lit("」")))


def evidence(scored: dict[str, Column]) -> Column:
    """The explanation: framing, up to three signals, notes; at most 400 characters."""
    v, fired, notes = scored["verdict"], scored["fired"], scored["notes"]
    nothing = F.array().cast("array<string>")
    one = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(nothing)
    few = F.size(F.slice(fired, 1, 3)) < 2
    model = (scored["ml_boosted"] & few) | ((~(scored["ml_boosted"] & few)) & (scored["ml_score"] >= C.MODEL_NOTE_FROM))
    title = F.try_element_at(_table(C.TITLES), scored["category"])
    table = _table(C.TEMPLATES)
    clauses = F.transform(F.slice(fired, 1, 3), lambda x: clause(x, table))
    positive = F.concat(
        F.array(F.when(v == "malicious", C.FRAME_MALICIOUS).otherwise(C.FRAME_SUSPICIOUS)),
        clauses,
        one(scored["synergy"] & (v == "malicious"), C.CHAIN_NOTE),
        one(model, C.MODEL_NOTE),
        one(scored["semantic_boosted"], C.MISMATCH_NOTE),
        notes,
        F.when(title.isNotNull(), F.array(F.concat(F.lit("归类："), title, F.lit("。")))).otherwise(nothing),
    )
    benign = F.concat(F.when(F.size(fired) > 0, F.concat(F.array(F.lit(C.FRAME_WEAK)), F.slice(clauses, 1, 1))).otherwise(F.array(F.lit(C.FRAME_CLEAN))), F.slice(notes, 1, 1))
    text = F.array_join(F.when(v == "benign", benign).otherwise(positive), " ")
    return F.when(F.length(text) > C.EVIDENCE_CHARS, F.concat(F.substring(text, 1, C.EVIDENCE_CHARS - 1), F.lit("…"))).otherwise(text)


def results(scored: DataFrame) -> DataFrame:
    """skill_id, verdict, confidence, category, evidence; empty packages are benign at 0.9.

    A package marked `failed` (its text could not be read or folded) is suspicious at 0.4 under the category for what
    could not be scanned; the others are not affected.
    """
    x = scored.withColumn("category", category(F.col("verdict"), F.col("fired")))
    names = ("verdict", "fired", "notes", "ml_boosted", "ml_score", "synergy", "semantic_boosted", "category")
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in scored.columns else F.lit(False)
    pick = lambda error, empty, other: F.when(failed, error).when(F.col("empty"), empty).otherwise(other)
    return x.select(
        "skill_id",
        pick("suspicious", "benign", F.col("verdict")).alias("verdict"),
        pick(F.lit(0.4), F.lit(0.9), confidence(F.col("verdict"), F.col("r"), F.col("ml_boosted"))).alias("confidence"),
        pick(C.ERROR_CATEGORY.upper(), "", category_label(F.col("category"))).alias("category"),
        pick(C.ERROR_EVIDENCE, C.EMPTY_EVIDENCE, evidence({n: F.col(n) for n in names})).alias("evidence"),
    )
