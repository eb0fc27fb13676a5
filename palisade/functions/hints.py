"""What a text may hold: one cheap pass for each of many patterns, before the costly patterns themselves.

A pattern is loosened on the driver to one that RE2 knows and that matches wherever the pattern does: borders and
looks around fall away, long counts become open, classes take all letters beyond ASCII. Arrow's kernels run it in
linear time over whole batches. Where it first matches no match of the pattern begins before; the pattern itself is
tried from the start of that line on (borders of words are the same after a line's end as at a text's start), and not
at all on texts that it can't match.
"""

from __future__ import annotations

import re
import re._constants as S
import re._parser as parser
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from palisade.functions.literals import ODD_CASES

#: A character beyond ASCII, as bytes of UTF-8: the patterns are over bytes.
_WIDE = r"[\xC0-\xFF][\x80-\xBF]*"
_ASCII = {
    S.CATEGORY_DIGIT: "0-9",
    S.CATEGORY_SPACE: r"\x09-\x0D\x1C-\x20",
    S.CATEGORY_WORD: "0-9A-Za-z_",
    S.CATEGORY_NOT_DIGIT: r"\x00-/:-\x7F",
    S.CATEGORY_NOT_SPACE: r"\x00-\x08\x0E-\x1F!-\x7F",
    S.CATEGORY_NOT_WORD: r"\x00-/:-@\[-^`{-\x7F",
}
_ANY = rf"(?:[\x00-\x7F]|{_WIDE})"
_MOST, _LEAST = 3, 64


def _escaped(x: str) -> str:
    return "".join(chr(b) if chr(b).isascii() and chr(b).isalnum() else f"\\x{b:02X}" for b in x.encode())


def _char(code: int) -> str:
    c = chr(code)
    return _escaped(c) if code < 128 or c.lower() == c.upper() else _WIDE


def _class(items) -> str:
    if items[0][0] is S.NEGATE:  # the fewer are left out, the more match
        plain = [v for op, v in items[1:] if op is S.LITERAL and v < 128 and not chr(v).isalpha()]
        return rf"(?:[^{''.join(map(_char, plain))}\x80-\xFF]|{_WIDE})"
    out, wide = "", False
    for op, value in items:
        if op is S.LITERAL and value < 128:
            out += _char(value)
        elif op is S.RANGE and value[0] < 128:
            out, wide = out + f"{_char(value[0])}-{_char(min(value[1], 127))}", wide or value[1] > 127
        elif op is S.CATEGORY:
            out, wide = out + _ASCII[value], True
        elif op in (S.LITERAL, S.RANGE):
            wide = True
        else:
            return _ANY
    return f"(?:{'|'.join([f'[{out}]'] * bool(out) + [_WIDE] * wide)})" if wide else f"[{out}]"


def _is_word(item) -> bool:
    return item[0] is S.LITERAL and item[1] < 128 and chr(item[1]).isalnum()


def _sequence(items) -> str:
    out, items = [], list(items)
    for i, (op, value) in enumerate(items):
        if op is S.AT and value is S.AT_BOUNDARY and any(map(_is_word, items[max(0, i - 1) : i + 2])):
            out.append(r"\b")  # RE2's border, of ASCII words, is there wherever Java's is, beside such a character
        if op in (S.AT, S.ASSERT, S.ASSERT_NOT):
            continue
        if op is S.LITERAL:
            out.append(_char(value))
        elif op is S.IN:
            out.append(_class(value))
        elif op is S.SUBPATTERN:
            out.append(f"(?:{_sequence(value[3])})")
        elif op is S.BRANCH:
            out.append(f"(?:{'|'.join(map(_sequence, value[1]))})")
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT):
            least, most, sub = value
            count = f"{{{min(least, _LEAST)},{'' if most > _MOST or least > _LEAST else most}}}"
            out.append(f"(?:{_sequence(sub)}){count}")
        elif op in (S.ANY, S.NOT_LITERAL):
            out.append(_ANY)
        else:
            raise re.error(f"nothing is known of {op}")
    return "".join(out)


@cache
def loosened(pattern: str) -> str | None:
    """A pattern of RE2 that matches every text, but those with ODD_CASES, that pattern matches when case is ignored; None if there is none."""
    try:
        return "(?i)" + _sequence(parser.parse(pattern))
    except re.error:  # a pattern in another dialect
        return None


def any_of(strings: Iterable[str]) -> str:
    """A pattern of RE2 for texts that hold one of strings as it is."""
    return "|".join(map(_escaped, strings))


_ODD = any_of(ODD_CASES[1:-1])


def _first(texts: pa.Array, tests: tuple[tuple[str | None, ...], ...]) -> np.ndarray:
    """A row for each text: `places`, 0 where a text has one of ODD_CASES or a pattern is None."""
    out = np.full((len(texts), len(tests)), -1, np.int32)
    for i, patterns in enumerate(tests):
        rows, some = np.arange(len(texts)), texts
        for p in filter(None, patterns):
            hit = pc.fill_null(pc.match_substring_regex(some, p), False)
            rows, some = rows[hit.to_numpy(zero_copy_only=False)], some.filter(hit)
        at = [pc.find_substring_regex(some, rf"[^\n]*(?:{p})").to_numpy(zero_copy_only=False) if p else np.zeros(len(some), np.int32) for p in patterns]
        out[rows, i] = np.minimum.reduce(at)
    odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False).to_numpy(zero_copy_only=False)
    out[odd] = 0
    return out


def places(text: Column, tests: tuple[tuple[str | None, ...], ...], alike: tuple[str, str] = ("", "")) -> Column:
    """For each test the byte at which the line of its first match begins; -1 where it is not passed. See `tail_sql`.

    A test is one or more patterns of RE2 that all match somewhere, the first match being that of any; None always does.
    alike: letters and what they stand for. For a text with one of the first as many numbers follow for the text with
    all of them replaced: 0 or -1, as bytes differ there.
    """
    table, letters, n = str.maketrans(*alike), any_of(alike[0]), len(tests)

    @F.arrow_udf(ArrayType(IntegerType()))
    def of(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        own = _first(texts, tests)
        if not table:
            return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * n, own.ravel())
        some = pc.fill_null(pc.match_substring_regex(texts, letters), False)
        where = some.to_numpy(zero_copy_only=False)
        plain = pa.array([t.decode().translate(table).encode() for t in texts.filter(some).to_pylist()], texts.type)
        both = np.full((len(texts), 2 * n), -2, np.int32)
        both[:, :n] = own
        if len(plain):
            both[where, n:] = np.minimum(_first(plain, tests), 0)
        ends = np.concatenate([[0], np.cumsum(np.where(where, 2 * n, n))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, both[both > -2])

    return of(text)


def may_sql(at: str, i: int) -> str:
    """False only if the text of those places can't pass test i."""
    return f"get({at}, {i}) >= 0"


def tail_sql(text: str, at: str, i: int) -> str:
    """What text holds from the place of test i on."""
    return f"cast(substring(cast({text} AS binary), get({at}, {i}) + 1) AS string)"


def may(at: Column, i: int) -> Column:
    """may_sql as a column."""
    return F.get(at, F.lit(i)) >= 0


def tail(text: Column, at: Column, i: int) -> Column:
    """tail_sql as a column."""
    return F.substring(text.cast("binary"), F.get(at, F.lit(i)) + 1, F.lit(2**31 - 1)).cast("string")
