"""The queries op1 to op10 against plain Python, on the smallest tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from palisade.llm import chat, chunking, exact_dedup, licenses, mixing, packing, pii, quality, queries, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, "Call +1 (988) 555-2485 or 4041894974608795, a@b.co+x@c.de. 1.2.3.4.5.6.7.8 256.1.1.1", "en", "a"),
    (2, "Call +1 (988) 555-2485 or\n4041894974608795,  a@b.co+x@c.de. 1.2.3.4.5.6.7.8 256.1.1.1", "en", "a"),
    (3, "", "en", None),
    (4, None, None, None),
    (5, " \t\n", "de", "b"),
    (6, "one", "en", "b"),
    (7, "ünï çödé 😀 words here and there and everywhere", "en", "c"),
    (7, "ünï çödé 😀 words here and there and everywhere", "en", "c"),
    (8, "word " * 30000, "en", "c"),
    (9, "x" * 60000 + "@" + "y.z" * 2000, "en", "d"),
    (10, "<|endoftext|> GB82 WEST 1234 5698 7654 32 iban; ssn 123-45-6789 0000-0000-0000-0000", "en", "d"),
    (11, "café naïve  " + "1" * 25 + " 00.000.0.0 +12345678 +(12", "en", "a"),
    (None, "no id", "en", "a"),
    (None, "no id", "en", "a"),
    (13, "hosts 10.0.0.1, 127.0.0.1 0.0.0.0 192.168.0.255 010.007.0.0099 1.0.256.0 1.00256.0.1 0.0.0.0000300", "en", "a"),
    (12, "Call +1 (988) 555-2485 or 4041894974608795, a@b.co+x@c.de. 1.2.3.4.5.6.7.8 256.1.1.1", "en", "zz"),
]
KIND = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module", params=["awkward", "table", "none"])
def case(request, spark, sf, tmp_path_factory):
    """(folder of tables, rows as (doc_id, text, source))."""
    folder = str(tmp_path_factory.mktemp(request.param))
    if request.param == "table":
        rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
        return sf, rows
    data = AWKWARD if request.param == "awkward" else []
    df = spark.createDataFrame(data, KIND)
    # columns whose names the operators use inside
    df = df.selectExpr("*", "1 AS rep", "'x' AS row", "2 AS size", "3 AS score", "4 AS `key`", "5 AS `a.b`")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(data) if r[0]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, [(r[0], r[1], r[3]) for r in data]


def bag(rows):
    return Counter(tuple(r) for r in rows)


def luhn(d):
    return sum(x if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[x] for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for k, ((pattern, ok), name) in enumerate(zip(rules, ("email", "ip", "card", "phone"), strict=True)):
        if name == "email" and "@" not in text:
            continue
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m.group())]
    return [x[2] for x in sorted(out)]


def test_op1(spark, case):
    folder, rows = case
    got = queries.op1_pii(spark, folder).collect()
    want = []
    for i, t, _ in rows:
        spans = base_spans(t or "") if len(t or "") < 10_000 or "@" not in t else [f"email:0:{len(t)}"]
        n = Counter(x.split(":")[0] for x in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == bag(want)
    for r in got:  # each span has its score
        assert len([x for x in r.scores.split(",") if x]) == r.n_spans == len([x for x in r.spans.split(",") if x])
    for r in got:  # base spans are among all
        assert len([x for x in r.spans.split(",") if x and x.split(":")[0] in ("email", "ip", "card", "phone")]) == r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pii_context_among_many_matches(spark):
    """Context words next to a match count wherever they stand between others; a long text takes time in proportion."""
    near, far = "ssn 123-45-6789 é" * 3, "x" * 60
    texts = [near + far + "123-45-6789", "123-45-6789 " * 3 + "is my ssn", "1.2.3.4 " * 8 + "host", "é b@c.de " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        t = texts[r.doc_id]
        for s in r.spans:
            k = next(k for k in pii.KINDS if k.name == s.kind)
            assert t[s.start : s.end] == s.match
            if r.doc_id < 3 or s.start < 2000:
                around = t[max(0, s.start - k.reach) : s.start] + "\n" + t[s.end : s.end + k.reach]
                assert s.score == pytest.approx(min(1.0, k.score + (k.lift if re.search(k.words, around, re.I) else 0)))
    spans = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert [s.start for s in spans[0]] == [4, 21, 38] and len(spans[1]) == 3 and len(spans[3]) == 5000


def test_pii_checksums_and_context(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "iban GB82 WEST 1234 5698 7654 33"), (3, "my ssn: 123-45-6789"), (4, "part 123-45-6789"), (5, "mail a@b.cd now")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [s.kind for s in got[1]] == ["iban"] and got[1][0].match == "GB82 WEST 1234 5698 7654 32"
    assert not got[2] and [s.kind for s in got[3]] == ["ssn"] and not got[4]
    assert got[5][0].score == 1.0
    assert {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id int, text string")).collect()}[5] == "mail <email> now"


def test_pii_more_kinds(spark):
    """IBANs before capitalised words and of other lengths, secrets by context and entropy."""
    ibans = ["ES9121000418450200051332", "AT611904300234573201", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "FR1420041010050500013M02606"]
    rows = [(i, f"bank account {x} EUR {x} Vienna") for i, x in enumerate(ibans)] + [(10, "to DE89 3704 0044 0532 0130 00 BIC COBADEFF"), (11, "DE89 3704 0044 0532 0130 01 ABC"), (12, "xDE89370400440532013000")]
    hexes = hashlib.sha1(b"x").hexdigest()
    rows += [(20, f'token = "{hexes}"'), (21, f"commit {hexes}"), (22, "token = aaaaaaaaaaaaaaaaaaaaaaaa1"), (23, "api_key: " + "Ab3" * 67), (24, "the secret of internationalisation-and-localisation")]
    got = {r.doc_id: [(s.kind, s.match) for s in r.spans if s.kind in ("iban", "secret")] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, x in enumerate(ibans):
        assert got[i] == [("iban", x)] * 2
    assert got[10] == [("iban", "DE89 3704 0044 0532 0130 00")] and got[20] == [("secret", hexes)]
    assert all(not got[i] for i in (11, 12, 21, 22, 23, 24))


def test_op2(spark):
    text = licenses.KNOWN[15][2]
    rows = [(1, text.upper()), (2, "Copyright (c) 2020 Someone\n\n" + text), (3, "words\n  released UNDER the MIT licence!\nReleased under the MIT License."), (4, None), (5, ""), (6, "Released under the MIT License, or not."), (None, "All rights reserved")]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert bag((r.doc_id, r.license, r.unit, r.n) for r in got) == bag([(1, "MIT", "text", 1), (2, "MIT", "text", 1), (3, "MIT", "line", 2), (None, "all-rights-reserved", "text", 1)])


def test_op2_on_any_rows(spark, case):
    """Against plain Python: canonical forms looked up as whole texts and whole lines."""
    folder, rows = case

    def canon(t):
        t = re.sub(licenses._COPYRIGHT, "", t.lower())
        for a, b in licenses.SPELLINGS:
            t = re.sub(a, b, t)
        return re.sub(r"[^\n\w]+|_+", " ", t)

    flat = lambda t: re.sub(r"\s+", " ", t).strip(" ")
    known = {}
    for a, k, t in licenses.KNOWN:
        known.setdefault(flat(canon(t)), (a, k))
    want = Counter()
    for i, t, _ in rows:
        lines = [x.strip(" ") for x in canon(t or "").split("\n")]
        units = [("text", flat(canon(t or "")))] + ([("line", x) for x in lines] if sum(x != "" for x in lines) > 1 else [])
        want += Counter((i, *known[x][:1], u, known[x][1]) for u, x in units if x in known)
    assert bag(queries.op2_license_scan(spark, folder).collect()) == bag((*k, n) for k, n in want.items())


def test_op2_finds_genuine_full_texts(spark):
    """Every full text as published, wrapped anew, under its usual titles and copyright lines."""
    from pathlib import Path

    texts, by = licenses.TEXTS, "Copyright (c) 2021, Someone\n\n"
    assert "In jurisdictions that recognize copyright laws" in texts["Unlicense"] and len(texts["GPL-3.0"]) > 35000
    rows = [(k, t) for k, t in texts.items()] + [(k, by + " ".join(t.upper().split(" "))) for k, t in texts.items()]
    rows += [("BSD-3-Clause", f"BSD 3-Clause License\n\n{by}All rights reserved.\n\n{texts['BSD-3-Clause']}"), ("Unlicense", "The Unlicense\n\n" + texts["Unlicense"])]
    mit, isc = (next(t for a, k, t in licenses.KNOWN if (a, k) == (x, "text")) for x in ("MIT", "ISC"))
    rows += [("MIT", mit.replace("MIT License", "The MIT License (MIT)\n\n" + by)), ("MIT", mit.replace("MIT License\n", by)), ("ISC", "ISC License\n\n" + by + isc)]
    rows += [("Apache-2.0", texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Someone")), ("GPL-2.0", texts["GPL-2.0"].split("END OF TERMS")[0])]
    two = re.sub(r"3\. Neither.*?permission\.\n\n", "", texts["BSD-3-Clause"], flags=re.S)
    assert "Neither" not in two
    rows += [("BSD-2-Clause", f"BSD 2-Clause License\n\n{by}{two}"), ("BSD-2-Clause", by + "All rights reserved.\n\n" + two), ("LGPL-2.1", texts["LGPL-2.1"].split("END OF TERMS")[0]), ("MPL-1.1", texts["MPL-1.1"].split("EXHIBIT A")[0])]
    debian = Path("/usr/share/common-licenses")
    rows += [(k, (debian / f).read_text()) for k, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("GFDL-1.3", "GFDL-1.3"), ("MPL-1.1", "MPL-1.1"), ("Artistic-1.0-Perl", "Artistic")) if (debian / f).exists()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(-1, texts["GPL-3.0"][:-400])], "doc_id int, text string")
    got = {r.doc_id: r.license for r in licenses.find_licenses(docs).where("unit = 'text'").collect()}
    assert got == {i: k for i, (k, _) in enumerate(rows)}


def test_op3(spark, case):
    folder, rows = case
    got = queries.op3_quality(spark, folder).collect()
    assert bag((r.doc_id, r.held_out) for r in got) == bag((i, i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def auc_of(pairs):
    pairs = list(pairs)
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out(spark):
    """Held-out accuracy at the threshold and rank quality on the sf0.1 tables, and what each kind of pooling gives.

    All of it comes from word vectors; the mean of them alone is tried too.
    """
    import numpy as np

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    model = quality.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in label]
    x = np.array([quality.pool(t, model.vectors) for _, t in rows])
    y = np.array([label[i] for i, _ in rows], float)
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows])
    score = model.score(x)
    auc, right = auc_of(zip(score[out], y[out], strict=True)), float(((score >= 0.3) == (y == 1))[out].mean())
    d = quality.DIM
    parts = {}
    for name, at in (("mean", slice(0, d)), ("spread", slice(d, 2 * d)), ("neighbours", slice(2 * d, 3 * d))):
        part = quality.train(quality.Model(model.vectors), x[~out][:, at], y[~out])
        parts[name] = auc_of(zip(part.score(x[out][:, at]), y[out], strict=True))
    print("held-out AUC", auc, "accuracy", right, "of each pooling alone", parts)
    assert auc > 0.97 and right > 0.95 and parts["mean"] > 0.85 and max(parts.values()) < auc + 0.01


def test_op3_is_the_plain_forward_pass(spark, sf):
    """Scores against the network written out word by word."""
    import math

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = {r.doc_id: r.score for r in queries.op3_quality(spark, sf).collect()}
    vectors, w1, w2 = m.vectors.tolist(), m.w1.tolist(), m.w2.tolist()
    for i in sorted(text)[:40]:
        words = [vectors[zlib.crc32(w.lower()) % quality.BUCKETS] for w in text[i].encode().split()]
        n = max(1, len(words))
        mean = [sum(v[k] for v in words) / n for k in range(quality.DIM)]
        spread = [math.sqrt(max(0, sum(v[k] ** 2 for v in words) / n - mean[k] ** 2)) for k in range(quality.DIM)]
        near = [sum(a[k] * b[k] for a, b in zip(words, words[1:], strict=False)) / n for k in range(quality.DIM)]
        z = [max(-8, min(8, (v - a) / s)) for v, a, s in zip(mean + spread + near, m.mean, m.scale, strict=True)]
        hidden = [math.tanh(sum(v * w1[r][c] for r, v in enumerate(z)) + m.b1[c]) for c in range(len(w2))]
        logit = (sum(h * w for h, w in zip(hidden, w2, strict=True)) + m.b2) / m.temperature + m.prior
        assert abs(1 / (1 + math.exp(-logit)) - got[i]) < 2e-3, i


def test_word_vectors_come_from_all_documents(spark, monkeypatch):
    """Held-out and unlabelled texts count too, null and long ones among them, against plain sums; the sample bounds the network only."""
    import numpy as np

    monkeypatch.setattr(quality, "_PIECE", 7)  # in the driver; texts of over 16384 words are cut in the workers
    monkeypatch.setattr(quality, "_BATCH", 2000)
    rows = [(i, f"good words number{i % 5} here", 1) for i in range(40)] + [(i, f"bad stuff number{i % 5} there", 0) for i in range(40, 80)]
    rows += [(i, f"Unlabelled rare{i} rare{i} text", None) for i in range(80, 90)] + [(None, "nobody knows", None), (91, None, None), (92, "", None), (93, "lone", None), (94, "over and over " * 6000, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id int, quality int")
    index, want = quality.index_vectors(quality.BUCKETS, quality.DIM, 1), np.zeros((quality.BUCKETS, quality.DIM + 1))
    for _, text, _ in rows:
        b = [zlib.crc32(w.lower()) % quality.BUCKETS for w in (text or "").encode().split()]
        for k, x in enumerate(b):
            want[x, quality.DIM] += 1
            for y in b[max(0, k - 1) : k] + b[k + 1 : k + 2]:
                want[x, : quality.DIM] += index[y]
    assert np.array_equal(quality.learn_vectors(t for _, t, _ in rows), want)
    model = quality.fit(docs, labels, sample=2)
    assert np.array_equal(model.vectors, quality.word_vectors(want))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: [(doc_id, fp)] -> component id by fingerprint."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, f in prints:
        least[root(f)].append(i)
    return {f: min((i for i in least[root(f)] if i is not None), default=None) for f in fps}


def test_op4(spark, case):
    folder, rows = case
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    comp = plain_components(prints)
    got = queries.op4_simhash(spark, folder).collect()
    assert bag((r.doc_id, r.fingerprint, r.component_id) for r in got) == bag((i, f"{f:016x}", comp[f]) for i, f in prints)


@pytest.mark.parametrize("pairs", [1, 4, 10**6])
def test_simhash_links_in_dense_groups(spark, pairs):
    """Many fingerprints around a few centres: keys beyond the limit are cut again, and exactly the close pairs are found."""
    import random

    rng = random.Random(5)
    fps = set()
    for _ in range(3):
        c = rng.getrandbits(64)
        for _ in range(120):
            f = c
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.links(nodes, block_pairs=pairs)
    order = sorted(map(signed, fps))
    assert bag(links.collect()) == bag((a, b) for k, b in enumerate(order) for a in order[:k] if ((a ^ b) % (1 << 64)).bit_count() <= 2)
    got = {r.node % (1 << 64): r.root for r in simhash.components(links).collect()}
    want = plain_components([(signed(f), f) for f in fps])
    assert {f: got.get(f, signed(f)) for f in fps} == want


def test_simhash_masks():
    """Two values at most 2 bits apart share a key of each round; the last round's keys leave 8 bits open."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        diff = (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        masks = simhash.block_masks(simhash.BLOCKS, 2)
        for open_bits in (32, 16, 8):
            assert all(64 - m.bit_count() == open_bits for m in masks)
            masks = [m for m in masks if not m & diff]
            assert masks
            masks = [z for m in masks for z in simhash.refined(m, simhash.BLOCKS, 2)]


def test_keep_one_of_each(spark, case):
    folder, rows = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    comp = plain_components([(i, plain_fingerprint(t)) for i, t, _ in rows])
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in comp.values() if c is not None})
    assert sum(i is None for i in ids) == sum(c is None for c in comp.values())  # these have no id in their groups, and are alone in them here


def plain_chat(rows):
    """rows: (conv_id, turn, role, text) -> {(conv_id, n_turns, copies, chat)}, pair by pair."""
    shown = lambda r, x: (r.strip(" ").lower() if (r or "").strip(" ").lower() in chat.ROLES else "user", (x or "").replace(chat.OPEN, "<| im_start|>").replace(chat.CLOSE, "<| im_end|>").strip(" "))
    talks, lone = defaultdict(list), []
    for c, t, r, x in rows:
        if c is None:
            lone.append((None, (shown(r, x),)))
        else:
            talks[c].append((t is None, t or 0, *shown(r, x)))
    every = [(c, tuple(x[2:] for x in sorted(v))) for c, v in talks.items()] + lone
    out = []
    for talk in {t for _, t in every}:
        if not any(len(t) > len(talk) and t[: len(talk)] == talk for _, t in every):
            ids = [c for c, t in every if t == talk]
            out.append((min((c for c in ids if c is not None), default=None), len(talk), len(ids), "".join(f"{chat.OPEN}{r}\n{x}{chat.CLOSE}\n" for r, x in talk)))
    return bag(out)


def test_op5(spark):
    talk = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "bye")]
    rows = [(c, t, r, x) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t, (r, x) in enumerate(talk[:n])]
    rows += [(5, 0, "user", "hi"), (5, 1, "robot", None), (None, 0, "user", "lost"), (None, 7, " USER ", "lost "), (None, 0, "user", "hi"), (6, None, None, "late"), (6, 0, "system", "be")]
    got = {r.conv_id: r for r in chat.chat_format(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert set(got) == {3, 5, 6, None} and got[3].copies == 2 and got[3].n_turns == 3
    assert got[None].chat == "<|im_start|>user\nlost<|im_end|>\n" and got[None].copies == 2 and got[None].n_turns == 1
    assert got[3].chat.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello <| im_end|><|im_end|>\n")
    assert chat.chat_format(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_op5_collapses_snapshots(spark, tmp_path):
    """Seeded logs of growing conversations, with copies, mixed role case, ties, nulls, long texts and clashing columns, against all pairs and SQL."""
    import random

    import duckdb

    rng = random.Random(11)
    rows, number = [], 0
    for _ in range(40):
        talk = [(rng.choice(["user", "User", "assistant", "TOOL ", "robot", None]), rng.choice(["yes", "no ", " why", None, "<|im_start|>", "é😀"])) for _ in range(rng.randint(1, 6))]
        for n in rng.sample(range(1, len(talk) + 1), rng.randint(1, len(talk))) + [len(talk)] * rng.randint(0, 2):
            number += 1
            rows += [(number, k if rng.random() < 0.9 else 0, r.swapcase() if r and rng.random() < 0.3 else r, x) for k, (r, x) in enumerate(talk[:n])]
    rows += [(None, k, "user", rng.choice(["yes", "alone", None])) for k in range(30)] + [(1000, 0, "user", "long " * 50000), (1001, None, None, None), (1001, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "2 AS h1", "'x' AS last", "3 AS lone", "4 AS copies")
    want = plain_chat(rows)
    assert bag(chat.chat_format(df.repartition(5)).collect()) == want and sum(want.values()) < number / 2
    df.write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert bag(con.execute(queries.oracle_sql()["op5_chat"]).fetchall()) == want


@pytest.mark.parametrize("part", [2, 4000])
def test_op6(spark, case, part):
    folder, rows = case
    if part == 2 and len(rows) > 50:
        part = 17
    got = chunking.next_likeness(spark.read.parquet(f"{folder}/documents.parquet"), part).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (chunking.chunk_set(x.encode()) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), chunking.digest(a), chunking.digest(b), round(chunking.containment(a, b), 9), round(chunking.containment(a, c), 9)))
    assert bag((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == bag(want)


def plain_chunks(data):
    """Byte by byte: the hash of the last 16 bytes, a strict test before the normal size and a loose one after it."""
    table = [int.from_bytes(hashlib.sha256(b"gear" + bytes([b])).digest()[:2], "little") for b in range(256)]
    ends, start, h = [], 0, 0
    for at, byte in enumerate(data):
        h = (h * 2 + table[byte]) % 65536
        size = at + 1 - start
        high = h >> 9
        if size >= 24 and len(data) - start > 24 and at + 1 < len(data) and (size >= 256 or (high % 128 == 0 if size < 64 else high % 32 == 0)):
            ends.append(at + 1)
            start = at + 1
    return ends + [len(data)] if data else []


def test_chunker_is_the_plain_one():
    import random

    rng = random.Random(9)
    texts = [r["text"].encode() for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:60]]
    texts += [bytes(rng.choices(b"ab \n", k=n)) for n in range(0, 400, 7)] + [b"x" * 5000, b""]
    for t in texts:
        assert chunking.chunks(t) == plain_chunks(t), t[:80]


def test_chunks_resist_shifts():
    import random

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij klmnop\n") for _ in range(20000)).encode()
    h, gear = 0, chunking.GEAR.tolist()
    for k, b in enumerate(text[:500]):  # the plain rolling hash
        h = ((h << 1) + gear[b]) & 0xFFFF
        assert k < 15 or h == chunking.gear_hash(text)[k]
    ends = chunking.chunks(text)
    assert ends[-1] == len(text) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= chunking.MAX
    a, b = chunking.chunk_set(text), chunking.chunk_set(text[:9000] + b"inserted" + text[9000:])
    assert chunking.containment(a, b) > 0.97 and chunking.containment(a, chunking.chunk_set(text[::-1])) < 0.05


def test_op7(spark, case):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows = case
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op7_packing(spark, folder).collect()
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t, _ in rows]
    left = defaultdict(list)
    for i, x in ids:
        left[i].append(x)
    # every piece's ids are those of a document with its doc_id, and the pieces of a document cover it once
    spans = defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in left[r.doc_id])
        spans[r.doc_id].append((r.start, r.length))
    for i, xs in left.items():
        assert sum(n for _, n in spans[i]) == sum(map(len, xs))
        if len(xs) == 1:
            at = 0
            for s, n in sorted(spans[i]):
                assert s == at
                at += n
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at and n > 0
            at += n
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two: no padding


def plain_nnls(a, b):
    """Lawson and Hanson's active sets."""
    import numpy as np

    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    while True:
        w = a.T @ (b - a @ x)
        w[free] = 0
        if w.max(initial=0) < 1e-9:
            return x
        free[w.argmax()] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 1e-12:
                break
            bad = free & (s <= 1e-12)
            step = (x[bad] / (x[bad] - s[bad])).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s


def test_packing_solves_the_least_squares(monkeypatch):
    """All combinations, and the same residual as a plain solver, whatever enters at once."""
    import numpy as np

    rng = np.random.default_rng(2)
    for window, enter in ((17, 512), (24, 3), (40, 20)):
        monkeypatch.setattr(packing, "_ENTER", enter)
        hist = np.bincount(rng.integers(1, window, 400), minlength=window).astype(float)
        combos = packing.combinations(hist)
        some = {tuple(sorted(x for x in c if x)) for c in combos.tolist()}
        have = [k for k in range(1, window) if hist[k]]
        assert some == {(a, window - a) for a in have if a <= window - a and window - a in have} | {tuple(sorted((a, b, window - a - b))) for a in have for b in have if window - a - b in have}
        scale = np.append(0, 1 / np.sqrt(np.maximum(hist[1:], 1)))
        matrix = np.zeros((window, len(combos)))
        for j, c in enumerate(combos):
            for x in c[c > 0]:
                matrix[x, j] += scale[x]
        x, want = packing.solve(hist, combos, rounds=3000, tolerance=1e-7), plain_nnls(matrix, hist * scale)
        assert x.min() >= 0
        off = lambda v: np.linalg.norm(matrix @ v - hist * scale)  # noqa: B023, E731
        assert abs(off(x) - off(want)) < 1e-3 * max(1, off(want))


def test_packing_prefers_whole_tails():
    import numpy as np

    rng = np.random.default_rng(0)
    hist = np.bincount(rng.integers(1, 1024, 50_000), minlength=1024)
    spans, ends, full = packing.plan(hist)
    took = np.zeros(1024, int)
    for s in spans:
        took[s["length"]] += s["hi"] - s["lo"]
    assert (took == hist).all()
    rest = sum(s["hi"] - s["lo"] for s in spans if s["rest"])
    assert rest < 0.05 * hist.sum()
    assert packing.plan(np.zeros(1024, int)) == ([], [], 0)


def test_op8(spark, case):
    folder, rows = case
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    shut = set()
    while True:
        free = sum(total.values()) - 3 * sum(total[s] for s in shut)
        x = {s: free * weight[s] / sum(weight[z] for z in order if z not in shut) for s in order if s not in shut}
        if not (over := {s for s in x if x[s] > 3 * total[s]}):
            break
        shut |= over
    target = {s: 3 * total[s] if s in shut else x[s] for s in order}
    got = queries.op8_mixing(spark, folder).collect()
    assert len(got) == len(rows) and bag(got) == bag(queries.op8_mixing(spark, folder).collect())
    of = {(i, size(t)): s for i, t, s in rows}
    taken, most = Counter(), Counter()
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-3
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-2, s


def test_mixing_splits_ties(spark):
    """Rows alike in doc_id and text: as many are taken as the target asks for, not all or none."""
    rows = [(None, "ten words " * 5, "a")] * 100 + [(None, "other words here " + str(i), "b") for i in range(300)] + [(7, "same id and text", "c")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan = mixing.mix_plan(docs).collect()
    size, target, taken = {}, {}, Counter()
    for r in plan:
        size[r.source], target[r.source] = r.size, r.target
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 3
    assert len(plan) == len(rows) and all(abs(taken[s] - target[s]) <= size[s] / 2 + 1e-6 for s in size)
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
    assert bag(plan) == bag(mixing.mix_plan(docs.repartition(3)).collect())


def test_mixing_has_unequal_rates(spark):
    """Each document has its own odds, and over many seeds it appears as often as its rate says."""
    rows = [(i, "w " * (2 ** (i % 10)), "a" if i % 4 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    cuts = mixing.cutoffs(mixing.measured(docs, 7)).collect()
    rate = {(r.s, r.b): r.copies + r.p for r in cuts if r.b}
    assert len({round(x, 6) for x in rate.values()}) > 10
    for s in "ab":
        words = Counter()
        for _, t, source in rows:
            if source == s:
                words[len(t.split()).bit_length()] += len(t.split())
        target = next(r.target for r in cuts if r.s == s)
        assert abs(sum(rate[s, b] * n for b, n in words.items()) - target) < 1e-6 * target
        # the damped odds, where neither floor nor cap cuts them
        free = [(b, rate[s, b]) for b in sorted(words) if rate[s, b] < 3 - 1e-9]
        assert all(abs(x / y - (c + 3) / (b + 3)) < 1e-9 for (b, x), (c, y) in zip(free, free[1:], strict=False))
    seen = Counter()
    for seed in range(4):
        for r in mixing.mix_plan(docs, seed).collect():
            seen[r.source, r.size.bit_length()] += r.copies
    n = Counter((s, len(t.split()).bit_length()) for _, t, s in rows)
    assert all(abs(seen[k] / (4 * n[k]) - rate[k]) < 0.3 for k in n)


def test_mixing_many_sources_with_same_ranks(spark):
    rows = [(i % 50, "w " * (1 + i % 9), f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    plan = mixing.mix_plan(docs)
    assert out.count() == plan.selectExpr("sum(copies)").first()[0]


def test_op9(spark, case):
    folder, rows = case
    got = queries.op9_sharding(spark, folder).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, of = defaultdict(list), defaultdict(set)
    load = Counter()
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        of[r.text_crc32, r.size].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in of.values())
    if len(rows) > 100:
        assert max(load.values()) < 1.1 * sum(load.values()) / 8


def test_op10(spark, case):
    folder, rows = case
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want, seen = [], set()
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep and (t, i) not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add((t, i))
    for size in (64, exact_dedup.BUCKET_BYTES):
        got = exact_dedup.exact_groups(spark.read.parquet(f"{folder}/documents.parquet"), size).collect()
        assert bag(got) == bag(want)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = exact_dedup.drop_exact_copies(docs, 1 << 16)
    assert out.columns == docs.columns and bag((r.doc_id,) for r in out.select("doc_id").collect()) == bag((k,) for t in groups for k in [min((x for x in groups[t] if x is not None), default=None)])


def test_exact_dedup_merges_hot_keys(spark, monkeypatch):
    """A text in every task, more representatives than a bucket holds: merged in rounds, and the groups are the same."""
    monkeypatch.setattr(exact_dedup, "MERGED", 3)
    rows = [(i, "hot  text " * 5 if i % 3 else f"cold text {i % 40}") for i in range(900)] + [(None, "hot text " * 5), (5, "hot text " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    staged = exact_dedup._staged(docs, [])
    reps, links = exact_dedup._merge_hot(staged.where("n IS NOT NULL"), 100)
    left = reps.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    assert len(links) >= 2 and all(r.n <= 3 or r.bytes <= 100 for r in left)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    seen, want = set(), []
    for i, t in norm:
        keep = min(x for x in groups[t] if x is not None)
        want.append((i, keep, len(groups[t]), i == keep and (t, i) not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add((t, i))
    assert bag(exact_dedup.exact_groups(docs, 100).collect()) == bag(want)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs, 100).collect()) == sorted({w[1] for w in want})


def test_exact_dedup_splits_below_the_directory(spark):
    """With a directory of two bits, overfull buckets get directories of their own, and no bucket of several keys stays overfull."""
    rows = [(i, f"text number {i // 2}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    reps = exact_dedup._staged(docs, []).where("n IS NOT NULL")
    dealt = exact_dedup._owned(reps, 200, False, 2)
    sizes = dealt.groupBy("bucket").agg({"size": "sum", "key": "max"}).collect()
    assert len(sizes) > 60 and max(r["sum(size)"] for r in sizes) <= 200
    ends = dealt.groupBy("bucket").agg({"key": "min"}).withColumnRenamed("min(key)", "a").join(dealt.groupBy("bucket").agg({"key": "max"}).withColumnRenamed("max(key)", "z"), "bucket").orderBy("bucket").collect()
    assert all(x.z < y.a for x, y in zip(ends, ends[1:], strict=False))  # key ranges
    got = exact_dedup.exact_groups(docs, 200, 2).collect()
    assert bag((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == bag((i, i // 2 * 2, 2, i % 2 == 0) for i, _ in rows)


def test_exact_dedup_chains_collisions():
    """Different texts under one key stay apart; the directory splits overfull buckets only."""
    c = exact_dedup._Chain(0, 7)
    for rep, (i, t) in enumerate([(5, b"a"), (3, b"b"), (2, b"a"), (None, b"b")]):
        c.add(0, rep, i, 1, "", len(t), t, None)
    assert [(x["id"], x["n"], x["keep"], x["reps"]) for x in c.links] == [(2, 2, 2, [0, 2]), (3, 2, 1, [1, 3])]
    depth, points = exact_dedup.directory({0: 10, 1: 10, 4: 1, 7: 1}, 3, 12)
    assert depth == 3 and points == [0, 1, 2, 2, 3, 3, 3, 3]
    assert exact_dedup.directory({}, 3, 12) == (0, [0])
    for t in (b"", b" ", b"\n a\x0b\x0cb ", b"a", b"\xc2\xa0 x"):
        assert exact_dedup.squeeze(t) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t)


def test_quality_pieces_agree(monkeypatch):
    import numpy as np

    vectors = quality.index_vectors(quality.BUCKETS, quality.DIM, 1)
    text = "some words some words!! | Again WORDS " * 50
    whole = quality.pool(text, vectors)
    monkeypatch.setattr(quality, "_PIECE", 7)
    assert np.allclose(whole, quality.pool(text, vectors), atol=1e-5)
    assert quality.pool(None, vectors).tolist() == [0.0] * quality.WIDTH


def plain_tree(groups, leaf, scale):
    """Nodes split by recursion: the widest dimension (the hash only where the others don't differ), at the bin edge next to the weighted median."""
    leaves = {}

    def split(node, rows):
        w = sum(r[0] for r in rows)
        wide = [(max(r[k] for r in rows) - min(r[k] for r in rows)) / scale[k - 1] if scale[k - 1] else 0 for k in (1, 2, 3)]
        d = 1 + wide.index(max(wide)) if max(wide) > 1e-9 else 4
        lo, hi = min(r[d] for r in rows), max(r[d] for r in rows)
        if w <= leaf or len(rows) == 1 or hi == lo:
            leaves[node] = w
            return
        step, bins = (hi - lo) / 512, defaultdict(list)
        for r in rows:
            bins[min(int((r[d] - lo) // step), 511)].append(r)
        below, best = 0, None
        for k in sorted(bins):
            if below and (best is None or abs(2 * below - w) < best[0]):
                best = (abs(2 * below - w), min(r[d] for r in bins[k]))
            below += sum(r[0] for r in bins[k])
        cut = best[1] if best else hi
        split(2 * node, [r for r in rows if r[d] < cut])
        split(2 * node + 1, [r for r in rows if r[d] >= cut])

    split(1, groups)
    return leaves


def test_kd_tree_is_the_plain_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    x = sharding.measured(docs).groupBy("group").agg(F.sum("size").alias("weight"), *[F.min(c).alias(c) for c in ("length", "source", "lang")])
    x = x.withColumn("hash", (F.xxhash64("group") / float(1 << 64)) + 0.5).cache()
    groups = [(r.weight, r.length, r.source, r.lang, r.hash) for r in x.collect()]
    scale = [max(g[k] for g in groups) - min(g[k] for g in groups) for k in (1, 2, 3, 4)]
    total = sum(g[0] for g in groups)
    for leaf in (total / 5, total / 60):
        got = sharding.build_tree(x, leaf, scale).leaves
        assert got == plain_tree(groups, leaf, scale)


def test_slots_without_ids(spark):
    """Rows without a doc_id and with one text are spread over the cells; slots are gapless."""
    docs = spark.createDataFrame([(None, "same")] * 500 + [(i, f"t{i}") for i in range(500)], "doc_id long, text string").repartition(4)
    slots = defaultdict(list)
    for r in sharding.shard_rows(docs, 3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 1000


def test_kd_tree_deals_every_leaf(spark):
    rows = [(i, "w" * (i % 200) + str(i % 400), f"s{i % 3}") for i in range(2000)] + [(i, "same", "s0") for i in range(3000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = sharding.shard_rows(docs, 4).groupBy("shard").sum("size").collect()
    load = [r[1] for r in out]
    assert len(load) == 4 and max(load) < 1.05 * sum(load) / 4


def test_shards_keep_to_the_target_bytes(spark, monkeypatch):
    """A target below 1/24 of a shard holds too."""
    seen = {}
    deal = sharding.deal
    monkeypatch.setattr(sharding, "deal", lambda leaves, shards: seen.update(leaves) or deal(leaves, shards))
    docs = spark.createDataFrame([(i, "w" * 9 + f"{i:05d}") for i in range(3000)], "doc_id int, text string")  # 15 bytes each
    out = sharding.shard_rows(docs, 2, 450)
    assert out.count() == 3000 and sum(seen.values()) == 45000 and max(seen.values()) <= 450
