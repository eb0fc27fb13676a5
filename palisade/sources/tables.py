"""Packages from tables, corpora and web-shaped rows, and the sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import manifests
from palisade.functions import text as tx
from palisade.operators import catalogue as C
from palisade.sources.directory import both

CORPUS = "id string, skill_name string, content string, label string, attack string"

# ---- Fixed values: words of a pattern's name and the category that they stand for, first match wins ----
PATTERN_CATEGORY = (
    ("prompt inject", "ast08"), ("instruction", "ast08"), ("jailbreak", "ast08"),
    ("deserial", "ast05"), ("pickle", "ast05"), ("yaml", "ast05"),
    ("supply", "ast02"), ("dependenc", "ast02"), ("typosquat", "ast04"),
    ("impersonat", "ast04"), ("metadata", "ast04"),
    ("privileg", "ast03"), ("permission", "ast03"),
    ("isolation", "ast06"), ("sandbox", "ast06"),
    ("update", "ast07"), ("version", "ast07"),
    ("cross-platform", "ast10"), ("reuse", "ast10"),
    ("exfil", "ast01"), ("credential", "ast01"), ("reverse shell", "ast01"),
    ("rce", "ast01"), ("malware", "ast01"), ("download", "ast01"),
)


def from_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Documents from (skill_id, md, helpers array<struct<fname, text>>); no size caps but that of the scan, binaries unknown.

    All of a package is in its row, so there is no shuffle, and rows that share a skill_id stay apart. Null texts count
    as empty; null helpers as none; other columns but those in keep are dropped.
    """
    nothing = F.array().cast("array<struct<fname:string,text:string>>")
    first = F.struct(F.lit("").alias("low"), F.coalesce("md", F.lit("")).alias("raw"))
    rest = F.transform(F.coalesce("helpers", nothing), lambda h: F.struct(F.lower(h["fname"]).alias("low"), F.coalesce(h["text"], F.lit("")).alias("raw")))
    x = rows.select(F.col("skill_id").cast("string").alias("skill_id"), F.concat(F.array(first), rest).alias("files"), *keep)
    # the texts go through normalisation and flattening as arrays: one call to Python a row, and only for rows that need it
    raw = F.transform("files", lambda f: f["raw"])
    x = x.withColumn("_wide", tx.fixed(tx.any_wide(raw)))
    x = x.withColumn("_folded", tx.nfkc_all(raw, F.col("_wide")))
    is_manifest = lambda f: F.coalesce(f["low"].isin(*C.MANIFEST_NAMES), F.lit(False))
    texts = F.transform(F.filter("files", is_manifest), lambda f: f["raw"])
    x = x.withColumn("_man", F.when(F.exists("files", is_manifest), manifests.with_flat(texts)).otherwise(F.array().cast("array<string>")))
    # a file without a name is code
    is_md = lambda i: (i == 0) | F.coalesce(tx.extension(F.element_at("files", i + 1)["low"]).isin(".md", ".markdown", ".txt"), F.lit(False))
    # what is ASCII only has no invisible characters
    clean = F.transform("_folded", lambda t, i: F.struct(is_md(i).alias("md"), F.when(F.col("_wide"), tx.strip_invisible(t)).otherwise(t).alias("t")))
    x = x.withColumn("_clean", tx.fixed(clean))
    joined = lambda md: F.array_join(F.transform(F.filter("_clean", lambda c: c["md"] == md), lambda c: c["t"]), "\n")
    x = x.withColumn("md", tx.fixed(joined(True))).withColumn("code", tx.fixed(joined(False))).withColumn("_whole", tx.fixed(both("md", "code")))
    return x.select(
        "skill_id", "md", "code", F.substring("_whole", 1, C.MAX_SCAN_CHARS).alias("all_text"),
        (F.col("_wide") & F.exists("_folded", lambda t: t.rlike(tx.INVISIBLE))).alias("has_zero_width"), F.array().cast("array<string>").alias("bundled_binaries"),
        (F.length("_whole") > C.MAX_SCAN_CHARS).alias("truncated"), (tx.is_blank(F.col("md")) & tx.is_blank(F.col("code"))).alias("empty"),
        manifests.manifest(F.col("_man"), F.col("md")).alias("manifest"), F.exists("_folded", lambda t: t.isNull()).alias("failed"), *keep,
    )


def from_texts(df: DataFrame, skill_id: Column, text: Column) -> DataFrame:
    """Documents of one text each, such as the rows of a corpus: no shuffle, as there is nothing to assemble."""
    x = df.withColumn("_id", skill_id.cast("string")).withColumn("_folded", tx.nfkc(F.coalesce(text, F.lit(""))))
    x = x.withColumn("_failed", F.col("_folded").isNull()).withColumn("_folded", F.coalesce("_folded", F.lit("")))
    x = x.withColumn("md", tx.fixed(tx.strip_invisible(F.col("_folded"))))
    nothing = F.array().cast("array<string>")
    return x.select(
        F.col("_id").alias("skill_id"), "md", F.lit("").alias("code"), F.substring("md", 1, C.MAX_SCAN_CHARS).alias("all_text"),
        (tx.count_invisible(F.col("_folded")) > 0).alias("has_zero_width"), nothing.alias("bundled_binaries"), (F.length("md") > C.MAX_SCAN_CHARS).alias("truncated"),
        tx.is_blank(F.col("md")).alias("empty"), manifests.manifest(nothing, F.col("md")).alias("manifest"), F.col("_failed").alias("failed"),
    )


def read_corpus(spark: SparkSession, *paths: str, label: str | None = None) -> DataFrame:
    """JSON-lines corpora, gzipped or not, with a default label; paths that don't exist are passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        q = jvm.org.apache.hadoop.fs.Path(p)
        if q.getFileSystem(conf).globStatus(q):
            there.append(p)
    x = spark.read.schema(CORPUS).json(there) if there else spark.createDataFrame([], CORPUS)
    return x.withColumn("label", F.coalesce("label", F.lit(label))) if label else x


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "true").json(path)


def union_corpora(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """All corpora in one, each with its default label."""
    out = None
    for df, label in parts:
        x = df.withColumn("label", F.coalesce("label", F.lit(label)) if "label" in df.columns else F.lit(label))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def truth(label: Column) -> Column:
    """benign, suspicious or malicious, from the spellings in use."""
    low = F.lower(F.coalesce(F.when(label == "", None).otherwise(label), F.lit("benign")))
    return F.when(low.isin("benign", "suspicious", "malicious"), low).when(low.isin("mal", "black"), "malicious").when(low.isin("gray", "grey"), "suspicious").otherwise("benign")


def truth_category(attack: Column) -> Column:
    up = F.upper(F.coalesce(attack, F.lit("")))
    return F.when(up.startswith("AST"), up).otherwise("")


def category_of_pattern(pattern: Column) -> Column:
    low = F.lower(F.coalesce(pattern, F.lit("")))
    out = F.lit("ast01")
    for needle, cat in reversed(PATTERN_CATEGORY):
        out = F.when(F.contains(low, F.lit(needle)), cat).otherwise(out)
    return out


def read_bench_csv(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark table whose columns may be spelled in two ways: skill_name or name, Pattern or pattern, classification."""
    x = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pick = lambda *names: F.coalesce(*[F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) for n in names if n in x.columns], F.lit(""))
    # Spark resolves names without regard to case, so one of two spellings is enough
    names = {c.lower(): c for c in x.columns}
    get = lambda *keys: pick(*[names[k] for k in keys if k in names])
    return x.select(get("skill_name", "name").alias("skill_name"), get("pattern").alias("pattern"), get("classification", "label").alias("classification")).withColumn("attack", category_of_pattern(F.col("pattern")))


def read_markdown_tree(spark: SparkSession, root: str, like: str = r"(?i)skill") -> DataFrame:
    """path, content of the .md files under root whose path looks like a package's; of any .md if none does."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    hits = x.where(F.col("path").rlike(like))
    none = hits.limit(1).select(F.lit(1).alias("one")).groupBy().count().where("count = 0")
    return hits.unionByName(x.join(F.broadcast(none), how="left_semi", on=F.lit(True)))


def first_text(*columns: str) -> Column:
    """The first of the columns that is not blank."""
    return F.coalesce(*[F.when(~tx.is_blank(F.col(c)), F.col(c)) for c in columns])


def label_of(config: Column, field: Column, positives: tuple[str, ...], negatives: tuple[str, ...]) -> Column:
    """1 or 0 from a label field where there is one, else from what the configuration's name begins with; null: neither."""
    pos, neg = tx.starts_with_any(config, positives), tx.starts_with_any(config, negatives)
    return F.when(field.isNotNull(), (field.cast("int") > 0).cast("int")).when(pos, 1).when(neg, 0)


def clamped(text: Column, least: int = 15, most: int = 2000) -> Column:
    """The first `most` characters of a text; null if it has fewer than `least` without the white space around it."""
    bare = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    return F.when(F.length(bare) >= least, F.substring(bare, 1, most))


def wrap_text(text: Column, key: Column) -> Column:
    """A text in a neutral package scaffold: one of three places for it, chosen by a hash of key."""
    place = F.pmod(F.xxhash64(key), F.lit(3))
    head = F.lit("---\nname: helper\ndescription: everyday helper\nversion: 1.0.0\n---\n\n# Helper\n\nHandy notes for a project.\n\n")
    return F.when(place == 0, F.concat(head, F.lit("## Notes\n\n"), text, F.lit("\n"))).when(place == 1, F.concat(head, text, F.lit("\n\n## Usage\n\nRun it.\n"))).otherwise(F.concat(head, F.lit("## Usage\n\nRun it.\n\n"), text, F.lit("\n")))


def materialize(rows: DataFrame, root: str) -> None:
    """Write (id, content) to `<root>/<id>/SKILL.md`, on a file system that executors share."""

    def write(part) -> None:
        for r in part:
            os.makedirs(os.path.join(root, r["id"]), exist_ok=True)
            with open(os.path.join(root, r["id"], "SKILL.md"), "w", encoding="utf-8", newline="\n") as f:
                f.write(r["content"] or "")

    rows.select("id", "content").foreachPartition(write)


def result_lines(results: DataFrame) -> DataFrame:
    """skill_id and line: the result as compact JSON with its keys in order."""
    return results.select("skill_id", F.to_json(F.struct("skill_id", "verdict", "confidence", "category", "evidence")).alias("line"))


def write_results(results: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines in the order of skill_id: range-partitioned files whose names are in order, or one file for small outputs."""
    lines = result_lines(results)
    lines = lines.repartition(1).sortWithinPartitions("skill_id") if one_file else lines.orderBy("skill_id")
    lines.select("line").write.mode("overwrite").text(path)
