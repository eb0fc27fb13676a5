"""Co-occurrence against all pairs, and texts with very many matches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import text as tx


@pytest.mark.parametrize("window", [0, 1, 3, 10])
def test_near_match(spark, window):
    rng = random.Random(window)
    texts = ["", "a", "b", "ab", "ba", *("".join(rng.choices("ab..........", k=rng.randint(0, 60))) for _ in range(300))]
    rows = [("".join(c if c != "a" else f"a{i:03d}" for i, c in enumerate(t)),) for t in texts]  # each a can be told apart
    x = spark.createDataFrame(rows, "long string").select("long", tx.near_match(F.col("long"), r"a\d{3}", "b", window).alias("m"))
    for r in x.collect():
        t = r["long"]
        a = [i for i, c in enumerate(t) if c == "a"]
        b = [i for i, c in enumerate(t) if c == "b"]
        want = next((t[i : i + 4] for i in a if any(abs(i - j) <= window for j in b)), None)
        assert r["m"] == want, t


def test_many_matches_take_linear_time(spark):
    text = "a " * 30000 + "." * 500 + "b " * 30000
    x = spark.createDataFrame([(text,)], "t string").select(tx.near_match(F.col("t"), "a", "b", 100).alias("m"), F.size(tx.match_places(F.col("t"), "a")).alias("n"), F.element_at(tx.match_places(F.col("t"), "b"), -1)["start"].alias("last"))
    t = time.time()
    assert x.first().asDict() == {"m": None, "n": 30000, "last": len(text) - 2}
    assert time.time() - t < 60
