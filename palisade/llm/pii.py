"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

All of it is DataFrame functions. A text is split at a pattern's matches; the lengths of the pieces and the matches,
summed up, give the offsets in code points. Patterns use possessive repeats and a look-behind that lets a match start
only where a run of its characters starts, so that no text makes them back-track more than linearly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    pattern: leftmost, non-overlapping. needs: a cheap test that a text must pass to hold a match at all. valid: the
    checksum or range test of a match. score: of a valid match by itself; words: context words (a regular expression)
    that raise it by `lift` when they stand within `reach` characters. least: the score that a span needs; 0 keeps all.
    """

    name: str
    pattern: str
    needs: str
    valid: object
    score: float
    words: str
    least: float = 0.0
    lift: float = 0.35
    reach: int = 48


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_ip(m: Column) -> Column:
    part = r"0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"  # a part has a digit, so one without others is zero
    return m.rlike(rf"\A{part}(?:\.{part}){{3}}\z")


def _is_card(m: Column) -> Column:
    d = F.when(F.length(m) <= 37, _digits(m))  # 19 digits and 18 separators
    n = F.length(d)
    # Luhn: every second digit from the right counts twice, less 9 above 9
    value = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substr(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(d, i, F.lit(1)).cast("int") + 1)),
    )
    return F.coalesce(F.when(n.between(12, 19), value % 10 == 0), F.lit(False))


def _is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


# ---- Fixed values: the length of an IBAN by country (ISO 13616) ----
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
# ---- End of fixed values ----


def _iban_pattern() -> str:
    """Country, two digits and as many further signs as the country has, in groups of four, with or without spaces."""
    kinds = []
    for n, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        kinds.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{fours}}}" + (f"\\x20?[A-Z0-9]{{{rest}}}" if rest else ""))
    return "(?:" + "|".join(kinds) + ")"


def _is_iban(m: Column) -> Column:
    """ISO 7064 mod 97-10: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    raw = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(raw, F.lit(5)), F.substring(raw, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _is_ssn(m: Column) -> Column:
    return ~m.rlike(r"\A(?:000|666|9)") & ~m.rlike(r"\A...-00-") & ~m.rlike(r"-0000\z")


def _bits(m: Column) -> Column:
    """Shannon entropy in bits a character."""
    n = F.length(m).cast("double")

    def add(acc: Column, c: Column) -> Column:
        share = (F.length(m) - F.length(F.replace(m, c, F.lit("")))) / n
        return acc - share * F.log2(share)

    return F.aggregate(F.filter(F.array_distinct(F.split(m, "")), lambda c: c != ""), F.lit(0.0), add)


def _is_secret(m: Column) -> Column:
    """A run of 20 to 200 signs with letters and digits among them, and at least 3 bits of entropy a sign."""
    return F.when(F.length(m).between(20, 200) & m.rlike("[0-9]") & m.rlike("[A-Za-z]"), _bits(m) >= SECRET_BITS).otherwise(F.lit(False))


SECRET_BITS = 3.0
#: Fixed by the contract, in its order: these four are always reported.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 0.9, r"e-?mail|mail|contact|write|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", _is_ip, 0.6, r"(?:^|[^a-z0-9])ip(?:[^a-z0-9]|$)|host|server|address|login|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _is_card, 0.7, r"card|credit|debit|visa|master|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _is_phone, 0.7, r"phone|tel|call|mobile|fax|whatsapp|contact"),
)
#: Added by the method; they need a checksum or context to be reported.
MORE = (
    Kind("iban", rf"(?<![A-Za-z0-9_]){_iban_pattern()}(?![A-Za-z0-9_])", "", _is_iban, 0.8, r"iban|bank|account|transfer|bic|swift", least=0.6),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", _is_ssn, 0.3, r"ssn|social[ \t\n]+security|taxpayer", least=0.6),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", "", _is_secret, 0.3, r"token|secret|api[ _-]?key|passw|credential|bearer|private[ _-]?key", least=0.6, reach=24),
)
KINDS = BASE + MORE

_BLOCK = 256
_SPAN = "struct<kind:string,start:int,end:int,match:string,score:double>"


def _spans(text: Column, k: Kind) -> Column:
    """The spans of one kind in a text, by start."""
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    gaps = F.split(text, k.pattern, -1)
    # the running place: each match starts after the gaps and matches before it; both arrays are worked out once
    empty = F.array().cast(f"array<{_SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def walk(v: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            # spans are added to those of a block, and blocks to the whole, so that few copies of long arrays are made
            some = F.sequence(b, F.least(b + _BLOCK - 1, F.size(v["m"])))
            start = F.struct(acc["at"].alias("at"), empty.alias("out"))
            return F.aggregate(some, start, lambda a, i: _step(k, v["m"], v["g"], a, i), lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

        blocks = F.sequence(F.lit(1), F.greatest(F.size(v["m"]), F.lit(1)), F.lit(_BLOCK))
        return F.aggregate(blocks, zero, block)["out"]

    walked = F.get(F.transform(F.array(F.struct(found.alias("m"), gaps.alias("g"))), walk), F.lit(0))
    has = text.contains(k.needs) if k.needs else F.lit(True)
    return F.when(has & text.rlike(k.pattern), walked).otherwise(empty)


def _before(k: Kind, found: Column, gaps: Column, i: Column) -> Column:
    """The k.reach characters before match i. They lie in the pieces next to it: a match has two characters or more, so
    k.reach / 2 matches and the gaps between them are enough, and no text is walked through for each of its matches."""

    def piece(j: Column) -> Column:
        return F.concat(F.coalesce(F.get(found, j - 2), F.lit("")), F.right(F.get(gaps, j - 1), F.lit(k.reach)))

    gap = F.get(gaps, i - 1)
    more = F.array_join(F.transform(F.sequence(F.greatest(i - k.reach // 2, F.lit(1)), i), piece), "")
    return F.right(F.when(F.length(gap) >= k.reach, gap).otherwise(more), F.lit(k.reach))


def _after(k: Kind, found: Column, gaps: Column, i: Column) -> Column:
    """The k.reach characters after match i, in the same way."""

    def piece(j: Column) -> Column:
        return F.concat(F.left(F.get(gaps, j - 1), F.lit(k.reach)), F.coalesce(F.get(found, j - 1), F.lit("")))

    gap = F.get(gaps, i)
    more = F.array_join(F.transform(F.sequence(i + 1, F.least(i + 1 + k.reach // 2, F.size(gaps))), piece), "")
    return F.left(F.when(F.length(gap) >= k.reach, gap).otherwise(more), F.lit(k.reach))


def _step(k: Kind, found: Column, gaps: Column, acc: Column, i: Column) -> Column:
    m = F.element_at(found, i)
    start = acc["at"] + F.length(F.element_at(gaps, i))
    end = start + F.length(m)
    # only looked at where the match is valid
    around = F.concat(_before(k, found, gaps, i), F.lit("\n"), _after(k, found, gaps, i))
    score = F.least(F.lit(1.0), F.lit(k.score) + F.when(around.rlike(f"(?i){k.words}"), F.lit(k.lift)).otherwise(F.lit(0.0)))
    ok = k.valid(m) if k.valid else F.lit(True)
    span = F.struct(F.lit(k.name).alias("kind"), start.alias("start"), end.alias("end"), m.alias("match"), score.alias("score"))
    out = F.when(ok & (score >= k.least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
    return F.struct(end.alias("at"), out.alias("out"))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and spans of every row: an array of (kind, start, end, match, score) by start, then kind as listed.

    Offsets are code points, the end exclusive. A match that fails its test is dropped and what it covers is not
    searched again. A null text counts as empty and gives an empty array; rows may repeat and doc_ids be null; an
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    each = src.select("doc_id", *[_spans(F.col("text"), k).alias(f"s{i}") for i, k in enumerate(kinds)])

    def keyed(i: int) -> Column:
        return F.transform(F.col(f"s{i}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s.alias("span")))

    ordered = map(keyed, range(len(kinds)))
    return each.select("doc_id", F.transform(F.array_sort(F.concat(*ordered)), lambda x: x["span"]).alias("spans"))


def mask(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; overlapping spans go as one, under the first's kind."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def keyed(i: int) -> Column:
        return F.transform(_spans(F.col("text"), kinds[i]), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))

    each = src.select("doc_id", "text", F.concat(*map(keyed, range(len(kinds)))).alias("s"))
    out = F.aggregate(
        F.array_sort("s"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)),
    )
    return each.select("doc_id", out.alias("text"))
