"""Declared metadata of a package: field extraction and the signals that its structure gives."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palisade.functions import hints
from palisade.functions import text as tx
from palisade.functions.literals import quoted
from palisade.operators import catalogue as C

# ---- Fixed values: field names and patterns ----
FRONT_MATTER = r"(?s)\A(?U:\s*)---(?U:\s*)\n(.*?)\n---(?U:\s*)(?:\n|\z)"
NAME_FIELDS = ("name", "skill_name", "id", "title")
DESCRIPTION_FIELDS = ("description", "desc", "summary", "about")
AUTHOR_FIELDS = ("author", "publisher", "maintainer", "vendor", "owner")
VERSION_FIELDS = ("version", "ver")
PLATFORMS = ("openclaw", "claude", "cursor", "vscode", "vs code", "windsurf", "copilot", "continue")
PERMISSION_KEY = r"(?:permission|scope|capabilit|access|allow|grant|tool)"
BROAD_PERMISSION = (
    r"(?:/\*\*|\"\*\"|'\*'|:\s*\"?\*\"?|\ball\b|\bany\b|read[_\-]?all|full[_\-]?access|all[_\-]?files|unrestricted|filesystem|"
    r"\"shell\"\s*:\s*true|\bexec\b|run[_\-]?command|arbitrary)"
)
OPEN_NETWORK = (
    r"(?:\"?network\"?\s*[:=]\s*(?:true|\"?\*\"?|\"any\"|\"all\")|\"?egress\"?\s*[:=]\s*(?:\"\*\"|\"any\"|true)|"
    r"allow[_\-]?network\s*[:=]\s*true|\"?outbound\"?\s*[:=]\s*\"\*\")"
)
NO_SANDBOX = (
    r"(?:\"?sandbox\"?\s*[:=]\s*(?:false|\"none\"|\"off\")|\"?isolation\"?\s*[:=]\s*\"none\"|run[_\-]?in[_\-]?host|"
    r"\"?host[_\-]?mode\"?\s*[:=]\s*true|no[_\-]?sandbox)"
)
ISOLATION_WORD = r"sandbox|container|isolat"
HARMLESS_DESCRIPTION = r"(?:format|convert|lint|style|prettif|render|markdown|note|todo|summar|translat|spell|grammar|emoji|color|theme|template|snippet)"
DANGEROUS_CAPABILITY = (
    r"(?:shell|exec|subprocess|os\.system|child_process|credential|api[_\s-]?key|token|~/\.ssh|\.aws|network|curl|wget|socket|/dev/tcp)"
)
INTEGRITY = r"(?:content[_\-]?hash|integrity|sha256|sha-256|checksum|\"hash\"|signature|signed|digest)"
DRIFT = r"(?:[:=]\s*\"?(?:\^|~|>=|>)\s*\d|[:=]\s*\"?\*\"?|@latest\b|\"version\"\s*:\s*\"(?:\*|latest|x)\"|:\s*latest\b)"
AUTOSTART = (
    r"launchagents|launchdaemons|\.plist\b",
    r"systemctl|/etc/systemd|/etc/cron|crontab|\.bashrc|\.zshrc",
    r"hkcu|hkey_current_user|currentversion\\\\?run|reg\s+add|schtasks",
)
# ---- End of fixed values ----
#: The tests of `hints` that signals() knows, the first of the scan's.
TESTS = (*((hints.loosened(p),) for p in AUTOSTART), ("(?i)" + hints.any_of(C.SENSITIVE_PATHS),))


def flatten_json(text: str | None) -> str | None:
    """All keys and scalars of a JSON text, depth first, with spaces between; null where it isn't JSON."""
    if not text or text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError, MemoryError):
        return None
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            for k, v in reversed(x.items()):
                todo += [v, _Key(k)]
        elif isinstance(x, list):
            todo += reversed(x)
        elif x is not None:
            out.append(str(x))
    return " ".join(out)


class _Key(str):
    """A key waiting for its turn among the values."""


@F.pandas_udf(StringType())
def _flatten_udf(s: pd.Series) -> pd.Series:
    return s.map(flatten_json)


def flat_json(text: Column) -> Column:
    """Null where the text isn't JSON; Python sees those only that begin like it."""
    return tx.guarded(_flatten_udf, text, text.rlike(r"(?U)\A\s*[{\[]"))


@F.pandas_udf(ArrayType(StringType()))
def _with_flat_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [y for x in xs for y in (x, flatten_json(x)) if y is not None], na_action="ignore")


def with_flat(texts: Column) -> Column:
    """An array of texts, each followed by its flattened form where it is JSON; Python sees those rows only that have one that begins like it."""
    some = F.exists(texts, lambda t: t.rlike(r"(?U)\A\s*[{\[]"))
    return F.when(some, tx.guarded(_with_flat_udf, texts, some)).otherwise(texts)


def front_matter(md: Column) -> Column:
    """What stands between the two lines of dashes at the start; null without them."""
    return F.when(md.rlike(FRONT_MATTER), F.regexp_extract(md, FRONT_MATTER, 1))


def field(raw: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of names that occurs, JSON or YAML style; "" for none."""
    out = "''"
    for n in reversed(names):
        pattern = quoted(rf'{tx.FLAGS}(?:"{n}"|\b{n})\s*[:=]\s*"?([^"\n,}}\]]+)')
        value = f"btrim(regexp_replace(regexp_extract(d.raw, {pattern}, 1), {quoted(_ENDS)}, ''), {quoted(_MARKS)})"
        out = f"if(d.raw rlike {pattern}, {value}, {out})"
    return tx.over(out, raw=raw)


_ENDS, _MARKS = r"(?U)\A\s+|\s+\z", "'\"` "


def manifest(files: Column, md: Column) -> Column:
    """The manifest struct from the raw texts of manifest files, in order, and the documentation.

    files: array of texts, each followed by its flattened form where it is JSON.
    """
    fm = front_matter(md)
    parts = F.concat(F.filter(files, lambda t: t.isNotNull() & (t != "")), F.when(fm.isNotNull(), F.array(fm)).otherwise(F.array().cast("array<string>")))
    fields = {"name": NAME_FIELDS, "description": DESCRIPTION_FIELDS, "author": AUTHOR_FIELDS, "version": VERSION_FIELDS}

    def of(v: Column) -> Column:
        known = {k: field(v["raw"], names) for k, names in fields.items()}
        return F.struct(
            (F.size(v["parts"]) > 0).alias("present"),
            *[c.alias(k) for k, c in known.items()],
            v["raw"].alias("raw_text"),
            F.filter(tx.strings(PLATFORMS), lambda p: F.contains(F.lower(v["raw"]), p)).alias("platforms"),
        )

    return tx.let(of, parts=parts, raw=F.array_join(parts, "\n"))


def look_alike(name: Column, known: tuple[str, ...] = C.KNOWN_NAMES) -> Column:
    """The first known name that is 1 or 2 edits from name, unless an equal one stands before it; null if none."""
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    marks = F.transform(tx.strings(known), lambda k: F.struct(k.alias("k"), F.levenshtein(bare, k, 2).alias("d")))
    first = F.get(F.filter(marks, lambda m: m["d"].between(0, 2)), F.lit(0))
    return F.when(F.length(bare).between(3, 24) & (first["d"] >= 1), first["k"])


def signals(doc: dict[str, Column]) -> list[tuple[str, Column]]:
    """(id, snippet) in order; a null snippet means that the signal has not fired. doc may have `at`, the places of TESTS and of others."""
    man, all_text, at = doc["manifest"], doc["all_text"], doc.get("at", F.array_repeat(F.lit(0), len(TESTS)))
    raw, name, description = man["raw_text"], man["name"], man["description"]
    some = F.length(raw) > 0
    perm = some & tx.has_match(raw, PERMISSION_KEY)
    path = F.when(hints.may(at, len(AUTOSTART)), tx.let(lambda v: F.get(F.filter(tx.strings(C.SENSITIVE_PATHS), lambda p: F.contains(v["low"], p)), F.lit(0)), low=F.lower(hints.tail(all_text, at, len(AUTOSTART)))))
    open_ = F.when(some, tx.first_match(raw, NO_SANDBOX))
    bare = path.isNotNull() & ~(some & tx.has_match(raw, ISOLATION_WORD))
    drift = F.when(some & ~tx.has_match(raw, INTEGRITY), tx.first_match(raw, DRIFT))
    alike = F.when(name != "", look_alike(name))
    hits = ", ".join(f"if({hints.may_sql('d.at', i)}, {tx.first_sql(hints.tail_sql('d.t', 'd.at', i), p)}, null)" for i, p in enumerate(AUTOSTART))
    starts = tx.over(f"array_compact(array({hits}))", t=all_text, at=at)
    several = tx.let(lambda v: F.when(F.size(v["starts"]) >= 2, F.array_join(v["starts"], " / ")), starts=starts)
    out = [
        ("S_over_privileged", F.when(perm, tx.first_match(raw, BROAD_PERMISSION))),
        ("S_unrestricted_network", F.when(some, tx.first_match(raw, OPEN_NETWORK))),
        ("S_weak_isolation", F.when(open_.isNotNull(), open_).when(perm & bare, path)),
        ("S_update_drift", drift),
        ("S_typosquat", F.when(alike.isNotNull(), F.concat(name, F.lit("≈"), alike))),
        ("S_metadata_mismatch", F.when((description != "") & tx.has_match(description, HARMLESS_DESCRIPTION) & tx.has_match(raw, DANGEROUS_CAPABILITY), F.concat(F.lit("desc:"), F.substring(description, 1, 40)))),
        ("S_cross_platform_reuse", several),
    ]
    return [(k, F.substring(s, 1, 80)) for k, s in out]
