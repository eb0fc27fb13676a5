"""The queries that apply the ten operators to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import chat, chunking, exact_dedup, licenses, mixing, packing, pii, quality, sharding, simhash
from palisade.llm.common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    base = [k.name for k in pii.BASE]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        # of each span, in the same order: the score after the context words, in hundredths
        F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    x = quality.score(docs, model).select("row.doc_id", "score")
    return x.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash.near_groups(documents(spark, sf_dir))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.next_likeness(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixing.mix_plan(documents(spark, sf_dir))
    return x.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sharding.shard_rows(documents(spark, sf_dir), 8)
    return x.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_license_scan, op3_quality, op4_simhash, op5_chat, op6_fingerprints, op7_packing, op8_mixing, op9_sharding, op10_exact_dedup)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _license_sql() -> str:
    known = ", ".join(f"({i}, {_quoted(a)}, {_quoted(k)}, {_quoted(t)})" for i, (a, k, t) in enumerate(licenses.KNOWN))

    def canonical(x: str) -> str:
        x = f"regexp_replace(lower({x}), {_quoted(licenses._COPYRIGHT)}, '', 'g')"
        for pattern, to in licenses.SPELLINGS:
            x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
        return rf"regexp_replace({x}, '[^\n\p{{L}}\p{{N}}]+', ' ', 'g')"

    flat = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS k(i, license, kind, text)),
canon AS (SELECT {flat.format(canonical("text"))} AS t, arg_min(license, i) AS license, arg_min(kind, i) AS kind FROM known GROUP BY 1),
docs AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS text FROM documents),
lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '') AS lines, {flat.format("text")} AS flat FROM docs),
units AS (
  SELECT doc_id, 'text' AS unit, flat AS t FROM lines
  UNION ALL SELECT doc_id, 'line', unnest(lines) FROM lines WHERE len(lines) > 1)
SELECT doc_id, license, unit, kind, count(*) AS n FROM units JOIN canon USING (t) GROUP BY ALL"""


_CHAT_SQL = f"""
WITH shown AS (
  SELECT conv_id, turn, CASE WHEN lower(trim(coalesce(role, ''))) IN ('system', 'user', 'assistant', 'tool') THEN lower(trim(role)) ELSE 'user' END AS role,
         trim(replace(replace(coalesce(text, ''), '{chat.OPEN}', '<| im_start|>'), '{chat.CLOSE}', '<| im_end|>')) AS text, row_number() OVER () AS n FROM conversations),
keyed AS (SELECT *, CASE WHEN conv_id IS NULL THEN -n ELSE 0 END AS lone FROM shown),
convs AS (SELECT conv_id, lone, list(struct_pack(role := role, text := text) ORDER BY turn NULLS LAST, role, text) AS turns, count(*) AS n FROM keyed GROUP BY conv_id, lone),
one AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies, any_value(n) AS n FROM convs GROUP BY turns),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM one))
SELECT conv_id, n AS n_turns, copies, array_to_string(list_transform(turns, lambda t: '{chat.OPEN}' || t.role || chr(10) || t.text || '{chat.CLOSE}' || chr(10)), '') AS chat
FROM one ANTI JOIN prefixes USING (turns)"""

_MIX_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':7'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM docs GROUP BY source),
total AS (SELECT sum(source_size)::DOUBLE AS t FROM sources),
-- one round a step: share what is open by weight, close the sources that this puts above 3 times their size
rounds AS (
  SELECT 0 AS k, list(struct_pack(source := source, s := source_size, w := w, shut := false)) AS x FROM sources
  UNION ALL
  SELECT k + 1, list_transform(x, lambda a: struct_pack(source := a.source, s := a.s, w := a.w, shut := a.shut OR a.w * (t - 3 * coalesce(list_sum(list_transform(list_filter(x, lambda b: b.shut), lambda b: b.s)), 0)) / list_sum(list_transform(list_filter(x, lambda b: NOT b.shut), lambda b: b.w)) > 3 * a.s))
  FROM rounds, total WHERE k < 40),
ended AS (SELECT x, t, coalesce(list_sum(list_transform(list_filter(x, lambda b: b.shut), lambda b: b.s)), 0) AS shut_s, list_sum(list_transform(list_filter(x, lambda b: NOT b.shut), lambda b: b.w)) AS open_w FROM rounds, total WHERE k = 40),
targets AS (SELECT a.source AS source, a.s AS source_size, CASE WHEN a.shut THEN 3.0::DOUBLE * a.s ELSE a.w * (t - 3 * shut_s) / open_w END AS target FROM (SELECT unnest(x) AS a, t, shut_s, open_w FROM ended)),
classes AS (
  SELECT c.source, bits, words, 4.0::DOUBLE / (bits + 3) AS g, t.target
  FROM (SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM docs WHERE size > 0 GROUP BY ALL) c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
-- the factor that makes a class and all after it fit what the ones before leave, if those are capped
factors AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(g * words) OVER (PARTITION BY source ORDER BY bits ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM classes),
fits AS (SELECT source, arg_min(c, bits) AS c FROM factors WHERE c * g <= 3 GROUP BY source),
rates AS (SELECT a.source, bits, words, target, CASE WHEN f.c IS NULL THEN 3.0::DOUBLE ELSE greatest(least(f.c * g, 3.0::DOUBLE), 0.0::DOUBLE) END AS rate FROM factors a LEFT JOIN fits f ON a.source IS NOT DISTINCT FROM f.source),
split AS (SELECT *, floor(rate + 1e-12)::INT AS copies, greatest(rate - floor(rate + 1e-12), 0) AS p FROM rates),
wants AS (SELECT source, max(target) - sum(copies * words) AS want FROM split GROUP BY source),
ranked AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(s.copies, 0) AS copies, w.want, CASE WHEN s.p > 1e-12 THEN u / (1 - u) * (1 - s.p) / s.p END AS q
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  LEFT JOIN split s ON d.source IS NOT DISTINCT FROM s.source AND d.size > 0 AND length(bin(d.size)) = s.bits
  LEFT JOIN wants w ON d.source IS NOT DISTINCT FROM w.source),
run AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS words FROM ranked)
SELECT doc_id, size, source_size, round(target, 3) AS target, ((copies + CASE WHEN q IS NOT NULL AND words - size / 2.0 <= want THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM run"""

_EXACT_SQL = r"""
WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM x WINDOW w AS (PARTITION BY t)"""


def _kind_sql(i: int, kind: pii.Kind, pattern: str, ok: str) -> str:
    """(doc_id, i, kind, start, end, match, score) of one kind. ok: the test of m, digits are d. Places come from the pieces between matches."""
    p = _quoted(pattern)
    words = _quoted("(?i)" + kind.words)
    keep = "" if not kind.least else f" WHERE score >= {kind.least}"
    return f"""SELECT doc_id, {i} AS k, '{kind.name}' AS kind, s, e, score FROM (
  SELECT *, least(1.0, {kind.score} + CASE WHEN regexp_matches(right(substr(text, 1, s), {kind.reach}) || chr(10) || substr(text, e + 1, {kind.reach}), {words}) THEN {kind.lift} ELSE 0 END) AS score FROM (
    SELECT *, s + length(m) AS e FROM (
      SELECT doc_id, text, m[i] AS m, regexp_replace(m[i], '[^0-9]', '', 'g') AS d,
             (list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::BIGINT AS s
      FROM (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM docs WHERE regexp_matches(text, {p})))))
  WHERE {ok}){keep}"""


def _pii_sql() -> str:
    """Look-around is not to be had in this dialect: runs of a kind's signs are taken whole and tested."""
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN (length(d) - j) % 2 = 0 THEN d[j]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][d[j]::INT + 1] END)) % 10 = 0"
    mod97 = (
        "list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), "
        "lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END, 0) = 1"
    )
    bits = "(SELECT -sum(n / length(m) * log2(n / length(m))) FROM (SELECT count(*)::DOUBLE AS n FROM (SELECT unnest(string_split(m, '')) AS c) GROUP BY c))"
    say = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS HUGEINT), 0) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length(d) BETWEEN 12 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
        "iban": (rf"\b{pii._iban_pattern()}\b", mod97),
        "ssn": (r"[0-9-]+", r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(?:000|666|9)|^...-00-|-0000$')"),
        "secret": (r"[A-Za-z0-9+/_-]+", f"length(m) BETWEEN 20 AND 200 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {bits} >= {pii.SECRET_BITS}"),
    }
    kinds = ",\n".join(f"k{i} AS ({_kind_sql(i, k, *say[k.name])})" for i, k in enumerate(pii.KINDS))
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.BASE)
    span = "kind || ':' || s::VARCHAR || ':' || e::VARCHAR"
    base = ", ".join(_quoted(k.name) for k in pii.BASE)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{kinds},
found AS ({" UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(pii.KINDS)))}),
sums AS (SELECT doc_id, {counts}, count(*) AS n_spans, coalesce(string_agg({span}, ',' ORDER BY s, k) FILTER (kind IN ({base})), '') AS base, string_agg({span}, ',' ORDER BY s, k) AS spans,
  string_agg(round(score * 100)::INT::VARCHAR, ',' ORDER BY s, k) AS scores FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores
FROM docs LEFT JOIN sums USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Not in SQL: op3, op4 (XXH64), op6, op7, op9; tests hold these against brute force."""
    return {"op1_pii": _pii_sql(), "op2_license_scan": _license_sql(), "op5_chat": _CHAT_SQL, "op8_mixing": _MIX_SQL, "op10_exact_dedup": _EXACT_SQL}
