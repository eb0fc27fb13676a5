"""Packages on a shared file system: `<root>/<package>/**` as a Spark data source, and files to documents.

`spark.read.format("packages").load(root)` gives one row per file, and one row with null names for a package without
files. Files come in walk order: the files of a folder by name, then its sub-folders by name; hidden ones too.

A root with a scheme (`hdfs://`, `s3://`, `gs://`, `abfs://`, `file://`) is read through pyarrow's file systems, by the
same tasks; Spark's own binary file source would leave hidden files out and read large files whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palisade.functions import manifests
from palisade.functions import text as tx
from palisade.operators import catalogue as C

FILES = "skill_id string, dir array<string>, fname string, length bigint, content binary"
#: Packages that one task reads.
PACKAGES_A_TASK = 64


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return PackageReader(self.options["path"], int(self.options.get("packagesPerTask", PACKAGES_A_TASK)))


class Batch(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def _store(root: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a root with a scheme and the path there; None for a plain path."""
    return fs.FileSystem.from_uri(root.rstrip("/")) if "://" in root else None


def discover(root: str) -> list[str]:
    """The names of root's folders in order, links to folders too; none if root can't be listed."""
    try:
        if store := _store(root):
            system, top = store
            return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(top)) if x.type == fs.FileType.Directory)
        return sorted(n for n in os.listdir(root) if os.path.isdir(os.path.join(root, n)))
    except OSError:
        return []


class PackageReader(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root, size

    def partitions(self) -> list[InputPartition]:
        names = discover(self.root)
        return [Batch(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        store = _store(self.root)
        for package in partition.names:
            some = False
            for row in _stored_files(*store, package) if store else _local_files(self.root, package):
                some = True
                yield (package, *row)
            if not some:
                yield package, None, None, None, None


def _local_files(root: str, package: str) -> Iterator[tuple]:
    top = os.path.join(root, package)
    for folder, dirs, files in os.walk(top):
        dirs.sort()
        rel = os.path.relpath(folder, top)
        parts = [] if rel == "." else rel.split(os.sep)
        for fname in sorted(files):
            path = os.path.join(folder, fname)
            yield (parts, fname, *_head(fname, lambda path=path: (os.stat(path).st_size, open(path, "rb"))))


def _stored_files(system: fs.FileSystem, root: str, package: str) -> Iterator[tuple]:
    top = f"{root}/{package}"
    found = system.get_file_info(fs.FileSelector(top, recursive=True))
    for parts, x in sorted(((x.path[len(top) + 1 :].split("/")[:-1], x) for x in found if x.type == fs.FileType.File), key=lambda p: (p[0], p[1].base_name)):
        yield (parts, x.base_name, *_head(x.base_name, lambda x=x: (x.size, system.open_input_stream(x.path))))


def _head(fname: str, opened: Callable[[], tuple[int, Any]]) -> tuple[int | None, bytes | None]:
    """Length and first bytes of a file, one more than are used; files known to be executables are not opened."""
    if os.path.splitext(fname.lower())[1] in C.BINARY_EXTENSIONS:
        return None, None
    try:
        length, f = opened()
        with f:
            return length, f.read(C.MAX_FILE_BYTES + 1)
    except OSError:
        return None, b""


def read_packages(spark: SparkSession, root: str, packages_a_task: int = PACKAGES_A_TASK) -> DataFrame:
    spark.dataSource.register(PackageSource)
    return spark.read.format("packages").option("packagesPerTask", packages_a_task).load(root)


def route(files: DataFrame) -> DataFrame:
    """Adds low (the name in lower case), ext, kind ("binary", "md", "code" or null for what is not used) and raw (the text).

    A file is cut at 2 MiB and marked; more than 1 % NUL bytes make it binary. Known executables are binary by name.
    """
    low = F.lower("fname")
    cut = F.length("content") > C.MAX_FILE_BYTES
    head = F.when(cut, F.substring("content", 1, C.MAX_FILE_BYTES)).otherwise(F.col("content"))
    x = files.withColumn("low", low).withColumn("ext", tx.extension(F.col("low"))).withColumn("_cut", cut).withColumn("_head", head)
    # NULs: what hexadecimal shrinks by when they go
    text = F.make_valid_utf8(F.col("_head").cast("string"))
    nuls = F.length(text) - F.length(F.replace(text, F.lit("\x00"), F.lit("")))
    x = x.withColumn("_text", text).withColumn("_nul", nuls / F.greatest(F.length("_head"), F.lit(1)) > C.BINARY_NUL_SHARE)
    named = F.col("ext").isin(*C.BINARY_EXTENSIONS)
    texty = F.col("low").isin("skill.md") | F.col("ext").isin(*C.TEXT_EXTENSIONS) | (F.col("ext") == "")
    md = F.col("ext").isin(".md", ".markdown", ".txt")
    kind = F.when(F.col("fname").isNull(), None).when(named, "binary").when(F.col("_nul"), F.when(texty, "binary")).when(F.length("_text") == 0, None).when(md, "md").otherwise("code")
    raw = F.when(kind.isin("md", "code"), F.when(F.col("_cut"), F.concat("_text", F.lit("\n[TRUNCATED]"))).otherwise(F.col("_text")))
    return x.withColumn("kind", kind).withColumn("raw", raw).drop("_cut", "_head", "_text", "_nul")


def within_budget(routed: DataFrame, budget: int = C.MAX_PACKAGE_BYTES) -> DataFrame:
    """The files before each package's texts reach the budget, with ord (the walk's order) and truncated.

    The file that crosses the budget still counts; what comes after it does not, binaries included.
    """
    order = Window.partitionBy("skill_id").orderBy("dir", "fname")
    spent = F.coalesce(F.sum(F.octet_length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = routed.withColumn("ord", F.row_number().over(order)).withColumn("_spent", spent)
    x = x.withColumn("truncated", F.bool_or(F.col("_spent") >= budget).over(Window.partitionBy("skill_id")))
    return x.where(F.col("_spent") < budget).drop("_spent")


def both(md: str, code: str) -> Column:
    return F.when(F.col(code) != "", F.concat(md, F.lit("\n\n"), code)).otherwise(F.col(md))


def assemble(files: DataFrame) -> DataFrame:
    """Documents from routed files: skill_id, ord, low, kind, raw, fname, truncated.

    md and code are the normalised texts in order; all_text is both, cut at 600 000 characters. Manifest files are read
    raw. A package is empty if nothing but white space is left and it has no binaries; it has failed if a file's text
    could not be folded.
    """
    folded = tx.nfkc(F.col("raw"))
    x = files.withColumn("_folded", folded).withColumn("_invisible", tx.count_invisible(F.col("_folded"))).withColumn("_clean", tx.strip_invisible(F.col("_folded")))
    is_manifest = F.col("low").isin(*C.MANIFEST_NAMES) & F.col("raw").isNotNull()
    x = x.withColumn("_flat", manifests.flat_json(F.when(is_manifest, F.col("raw"))))
    part = lambda cond, value: F.collect_list(F.when(cond, F.struct("ord", value.alias("v"))))
    g = x.groupBy("skill_id").agg(
        part(F.col("kind") == "md", F.col("_clean")).alias("md"),
        part(F.col("kind") == "code", F.col("_clean")).alias("code"),
        part(F.col("kind") == "binary", F.col("fname")).alias("bin"),
        part(is_manifest, F.array("raw", "_flat")).alias("man"),
        F.coalesce(F.bool_or(F.col("_invisible") > 0), F.lit(False)).alias("has_zero_width"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
        F.coalesce(F.bool_or(F.col("raw").isNotNull() & F.col("_folded").isNull()), F.lit(False)).alias("failed"),
    )
    inorder = lambda c: F.transform(F.array_sort(c), lambda s: s["v"])
    g = g.select("skill_id", F.array_join(inorder("md"), "\n").alias("md"), F.array_join(inorder("code"), "\n").alias("code"), inorder("bin").alias("bundled_binaries"), F.flatten(inorder("man")).alias("_man"), "has_zero_width", "truncated", "failed")
    whole = both("md", "code")
    empty = tx.is_blank(F.col("md")) & tx.is_blank(F.col("code")) & (F.size("bundled_binaries") == 0)
    return g.select(
        "skill_id", "md", "code", F.substring(whole, 1, C.MAX_SCAN_CHARS).alias("all_text"), "has_zero_width", "bundled_binaries",
        (F.col("truncated") | (F.length(whole) > C.MAX_SCAN_CHARS)).alias("truncated"), empty.alias("empty"), manifests.manifest(F.col("_man"), F.col("md")).alias("manifest"), "failed",
    )


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    """One document per package under root, packages without files too."""
    return assemble(within_budget(route(read_packages(spark, root))))
