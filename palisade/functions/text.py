"""Text functions as Column builders: normalisation, confusables, entropy, blobs, decoding, match offsets.

Everything is built from Spark's own functions but NFKC, which Spark lacks; it runs as an Arrow UDF, which sees null
for every text that is ASCII only.

What the rules of the catalogue use is written in SQL (names end in `_sql`), as it would take thousands of calls to
build from columns; `over` makes a column of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palisade.functions.literals import may_match_sql, quoted

#: Flags under which patterns mean in Java what they mean in Python's re.IGNORECASE.
FLAGS = "(?iuU)"

# ---- Fixed values ----
#: Soft hyphen, zero-width and bidirectional controls, invisible operators, BOM, tags.
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{E0000}-\x{E007F}]"
#: Cyrillic and Greek letters and the Latin letters that they look like, in the same order.
CONFUSABLE_FROM = "аеосрхуѕіјкмнтвԁѵӏԛԝгΑΒΕΖΗΙΚΜΝΟΡΤΧΥορναεικ"
CONFUSABLE_TO = "aeocpxysijkmhtbdvlqwrABEZHIKMNOPTXYopvaeik"
MIXED_TOKEN = r"[A-Za-z\x{400}-\x{4FF}\x{370}-\x{3FF}\x{2010}-\x{2015}]{2,}"
MAX_TOKENS = 50_000
# a run can only be found from its start, so that shorter ones are passed over at once
BLOB = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{120,}+"
BASE64_RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{40,}+"
HEX_RUN = r"(?U)\b[0-9a-fA-F]{40,}\b"
MAX_BLOBS, MAX_DECODED = 24, 8192
_SPACE = r"(?U)\s+"

_NONE = "cast(array() AS array<struct<start:int,match:string>>)"
#: v (m: matches, g: gaps) -> their places. Places are added to those of a block, and blocks to the whole, so that few
#: copies of long arrays are made.
_WALK = f"""v -> if(size(v.m) = 0, {_NONE}, aggregate(
  sequence(1, size(v.m), 256), named_struct('pos', 0, 'out', {_NONE}),
  (t, first) -> aggregate(
    sequence(first, least(first + 255, size(v.m))), named_struct('pos', t.pos, 'out', {_NONE}),
    (s, i) -> named_struct(
      'pos', s.pos + length(element_at(v.g, i)) + length(element_at(v.m, i)),
      'out', concat(s.out, array(named_struct('start', s.pos + length(element_at(v.g, i)), 'match', element_at(v.m, i))))),
    s -> named_struct('pos', s.pos, 'out', concat(t.out, s.out)))).out)"""
#: v (a, b: places) -> see near_sql.
_CLOSE = """v -> get(transform(array(aggregate(
  array_sort(concat(transform(v.a, x -> named_struct('pos', x.start, 'side', 0)), transform(v.b, x -> named_struct('pos', x.start, 'side', 1)))),
  named_struct('a', -1000000000, 'b', -1000000000, 'low', cast(null AS int)),
  (s, x) -> named_struct(
    'a', if(x.side = 0, x.pos, s.a),
    'b', if(x.side = 0, s.b, x.pos),
    'low', coalesce(s.low, if(x.side = 0, if(x.pos - s.b <= {window}, x.pos, null), if(x.pos - s.a <= {window}, x.pos - {window}, null))))).low),
  low -> get(filter(v.a, x -> x.start >= low), 0).`match`), 0)"""


@F.pandas_udf(StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(_fold, na_action="ignore")


def _fold(x: str) -> str | None:
    try:
        return unicodedata.normalize("NFKC", x)
    except Exception:  # one text must not end the job; its package is reported as failed
        return None


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body over a struct of values that are worked out once; inside a lambda an outer expression would be worked out at every step."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def over(sql: str, **values: Column) -> Column:
    """An SQL expression over `d`, a struct of values that are worked out once."""
    return F.get(F.call_function("transform", F.array(F.struct(*[v.alias(k) for k, v in values.items()])), F.expr(f"d -> {sql}")), F.lit(0))


def fixed(value: Column) -> Column:
    """value behind a test that always holds but counts as non-deterministic: it is worked out where it stands, once a row.

    Without it the optimizer copies a costly expression into every filter on what is derived from it.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def guarded(udf: Callable[[Column], Column], text: Column, condition: Column) -> Column:
    """udf(text) where condition holds, else null. Spark works a Python UDF out for every row whatever stands around it,
    so the condition is put inside: other rows reach Python as null."""
    return udf(F.when(condition, text))


def nfkc(text: Column) -> Column:
    """NFKC; identity on ASCII; null where Python could not do it."""
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, guarded(_nfkc_udf, text, wide)).otherwise(text)


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [None if x is None else _fold(x) for x in xs], na_action="ignore")


def any_wide(texts: Column) -> Column:
    """Whether one of an array of texts is not ASCII only."""
    return F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7F]"))


def nfkc_all(texts: Column, wide: Column) -> Column:
    """nfkc of each of an array of texts; wide: any_wide(texts)."""
    return F.when(wide, guarded(_nfkc_all_udf, texts, wide)).otherwise(texts)


def count_invisible(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INVISIBLE))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def deconfuse(text: Column) -> Column:
    return F.translate(text, CONFUSABLE_FROM, CONFUSABLE_TO)


def mixed_script_token(text: Column) -> Column:
    """The first token that has both an ASCII letter and a Greek or Cyrillic one; null if none."""
    tokens = F.slice(F.regexp_extract_all(text, F.lit(MIXED_TOKEN), F.lit(0)), 1, MAX_TOKENS)
    found = F.get(F.filter(tokens, lambda t: t.rlike("[A-Za-z]") & t.rlike(r"[\x{370}-\x{4FF}]")), F.lit(0))
    return F.when(text.rlike(r"[\x{370}-\x{4FF}]"), found)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def bits(v: Column) -> Column:
        shares = F.transform(F.array_distinct(v["c"]), lambda c: F.size(F.filter(v["c"], lambda d: d == c)) / F.size(v["c"]).cast("double"))
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(bits, c=chars))


def entropy_blob(text: Column, min_chars: int, min_bits: float) -> Column:
    """The first long run of encoded-looking characters with so much entropy; null if none."""
    runs = F.regexp_extract_all(text, F.lit(BLOB), F.lit(0))
    found = F.get(F.filter(runs, lambda t: (F.length(t) >= min_chars) & (entropy(t) >= min_bits)), F.lit(0))
    return F.when(text.rlike(BLOB), found)


def _base64(run: Column) -> Column:
    std = F.regexp_replace(F.translate(run, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    pad = F.repeat(F.lit("="), F.pmod(-F.length(std), F.lit(4)))
    return F.when(F.length(std) >= 40, F.try_to_binary(F.concat(std, pad), F.lit("base64")))


def _hex(run: Column) -> Column:
    even = F.substr(run, F.lit(1), F.length(run) - F.length(run) % 2)
    return F.try_to_binary(even, F.lit("hex"))


def decoded(text: Column) -> Column:
    """Texts of the first blobs that decode from base64, then from hexadecimal: at most 24, of 8192 bytes."""
    runs = F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0))
    hexes = F.regexp_extract_all(text, F.lit(HEX_RUN), F.lit(0))
    raw = F.concat(F.transform(runs, _base64), F.transform(hexes, _hex))
    some = F.slice(F.filter(raw, lambda b: b.isNotNull() & (F.octet_length(b) > 0)), 1, MAX_BLOBS)
    return F.transform(some, lambda b: F.make_valid_utf8(F.substring(b, 1, MAX_DECODED).cast("string")))


def first_sql(text: str, pattern: str, low: str | None = None) -> str:
    """The first match's text; null if there is none. low: the text's lowered form, to pass over texts that can't match."""
    found = f"regexp_substr({text}, {quoted(FLAGS + pattern)})"
    return found if low is None else f"if({may_match_sql(low, pattern)}, {found}, null)"


def places_sql(text: str, pattern: str) -> str:
    p = quoted(FLAGS + pattern)
    return f"get(transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))), {_WALK}), 0)"


def near_sql(text: str, pattern: str, near: str, window: int | None) -> str:
    """The first match of pattern that a match of near starts at most window characters from; null if none.

    Both sides' places are walked through once, in order. At the first place that is close to the last one of the
    other side, no match of pattern before `low` can be close to any of near: those so far are too far from it, and
    later ones are farther.
    """
    tests = [f"{text} rlike {quoted(FLAGS + p)}" for p in (pattern, near)]
    found = first_sql(text, pattern)
    if window is not None:
        found = f"get(transform(array(named_struct('a', {places_sql(text, pattern)}, 'b', {places_sql(text, near)})), {_CLOSE.format(window=int(window))}), 0)"
    return f"if({' AND '.join(tests)}, {found}, null)"


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, {quoted(_SPACE)}, ' '))"


def first_match(text: Column, pattern: str) -> Column:
    """The first match's text; null if there is none."""
    return F.regexp_substr(text, F.lit(FLAGS + pattern))


def has_match(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def match_places(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, match); starts are code points from 0. The gaps between matches give them."""
    return over(places_sql("d.t", pattern), t=text)


def near_match(text: Column, pattern: str, near: str, window: int | None) -> Column:
    """near_sql as a column."""
    return over(near_sql("d.t", pattern, near, window), t=text)


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return F.exists(strings(needles), lambda n: F.contains(text, n))


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(strings(prefixes), lambda p: F.startswith(text, p))


def strings(xs: tuple[str, ...]) -> Column:
    """A constant array, in one call."""
    return F.expr(f"array({', '.join(map(quoted, xs))})")


def extension(name: Column) -> Column:
    """The extension of a lower-case name with its dot; "" for none. Leading dots belong to the name."""
    return F.regexp_extract(name, r"\A\.*[^.].*(\.[^.]*)\z", 1)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
