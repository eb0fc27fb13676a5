"""The literal test never rules out a text that a pattern matches."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions.literals import ODD_CASES, lowered, may_match_sql, required
from palisade.operators import catalogue as C

PATTERNS = sorted({p for r in C.RULES for p in (r.pattern, r.near) if p} | {C.PRIMITIVE})


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_holds_a_required_literal(pattern):
    need = required(pattern)

    @settings(max_examples=60, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.IGNORECASE)))
    def check(text):
        assert not need or re.search(ODD_CASES, text) or any(n in text.lower() for n in need)

    check()


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"abc", ("abc",)),
        (r"(?:Foo|ba[rz])\s+x", ("bar", "baz", "foo")),
        (r"\bcolou?rs?\b", ("color", "colors", "colour", "colours")),
        (r"(?:ab)+c", ("ab",)),
        (r"(?:abc)?d*", ()),
        (r"[^a]\w+", ()),
        (r"密码\d", ("密码",)),
        (r"(?:abc|\d+)", ()),
        (r"a(?!b)cd", ("acd",)),
        (r"\p{L}+abc", ()),
    ],
)
def test_required(pattern, want):
    assert required(pattern) == want


def test_may_match_in_spark(spark):
    rows = [("WGET it",), ("nothing",), ("ſh and İ",), ("",), (None,)]
    x = spark.createDataFrame(rows, "t string").select("t", lowered(F.col("t")).alias("low")).selectExpr("t", may_match_sql("low", "wget|curl") + " AS m")
    assert [r["m"] for r in x.collect()] == [True, False, True, False, True]
