"""The pipeline's stages, each replayed by plain Python on what the one before it has left."""

import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from palisade.llm import quality, simhash
from palisade.llm.common import documents, stored


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    out = [documents(spark, sf)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quality_drops_what_it_rejects(spark, sf, steps):
    docs, kept = steps[0], steps[1]
    assert kept.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    at = docs.columns.index("text")
    want = Counter(r for r in rows(docs) if model.score(quality.pool(r[at], model.vectors)[None])[0] >= quality.THRESHOLD)
    assert Counter(rows(kept)) == want and 0 < sum(want.values()) < docs.count()


def test_exact_keeps_the_smallest_of_equal_texts(steps):
    before, after = rows(steps[1]), rows(steps[2])
    at, i = steps[1].columns.index("text"), steps[1].columns.index("doc_id")
    best = {}
    for r in before:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r[at])
        if t not in best or r[i] < best[t][i]:
            best[t] = r
    assert steps[2].columns == steps[1].columns and Counter(after) == Counter(best.values())


def test_near_keeps_the_smallest_of_each_group(steps):
    before, after = rows(steps[2]), rows(steps[3])
    at, i = steps[2].columns.index("text"), steps[2].columns.index("doc_id")
    prints = {r[i]: simhash.fingerprint(r[at].encode()) for r in before}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    stay = {find(d) for d in ids}
    assert steps[3].columns == steps[2].columns and Counter(after) == Counter(r for r in before if r[i] in stay)


def test_mixing_takes_the_targets(steps):
    before, after = Counter(rows(steps[3])), Counter(rows(steps[4]))
    at, s = steps[3].columns.index("text"), steps[3].columns.index("source")
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[at]))
    assert steps[4].columns == steps[3].columns and all(r in before and n <= 3 * before[r] for r, n in after.items())
    have, got, most = Counter(), Counter(), Counter()
    for r, n in before.items():
        have[r[s]] += words(r) * n
        most[r[s]] = max(most[r[s]], words(r))
    for r, n in after.items():
        got[r[s]] += words(r) * n
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sorted(have))}
    shut = set()
    while True:
        free = sum(have.values()) - 3 * sum(have[x] for x in shut)
        share = {x: free * weight[x] / sum(weight[y] for y in have if y not in shut) for x in have if x not in shut}
        over = {x for x in share if share[x] > 3 * have[x]}
        if not over:
            break
        shut |= over
    for x in have:
        assert abs(got[x] - (3 * have[x] if x in shut else share[x])) <= most[x] / 2 + 1, x


def test_packing_holds_every_token_once(steps):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(r.doc_id, np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], "<u4")) for r in steps[4].select("doc_id", "text").collect()]
    pieces = steps[5].collect()
    want, got = Counter(), Counter()
    for i, ids in docs:
        want[i] += len(ids)
    of = dict(docs)
    for p in pieces:
        got[p.doc_id] += p.length
        assert zlib.crc32(of[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert got == want
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert sorted(fill) == list(range(len(fill))) and all(n & (n - 1) == 0 and n <= 1024 for n in fill.values())


def test_run_is_the_chain(spark, sf, steps):
    assert Counter(rows(corpus_pipeline.run(spark, sf))) == Counter(rows(steps[-1]))


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, repeats and clashing columns go through; an empty table stays empty."""
    data = [(1, "same text here", "a"), (2, "same text here", "a"), (None, None, None), (3, "", "b"), (4, "w " * 20000, "b"), (5, "x", "a"), (5, "x", "a")]
    for name, some in (("some", data), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, "doc_id long, text string, source string").selectExpr("*", "1 AS row", "2 AS copies", "3 AS rep").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == (name == "some")
