"""What the corpus operators share: scratch tables, small literal tables, column helpers."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that words are split at: space, tab, LF, VT, FF, CR.
WS = r"\x20\x09-\x0D"

_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="palisade-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def run_dir(spark: SparkSession) -> str:
    """This driver's folder of scratch tables; removed when the driver's Python ends in the usual way."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/palisade-{app}"

        def clean() -> None:
            if spark.sparkContext._jsc is not None:
                remove(spark, _runs[app])

        atexit.register(clean)
    return _runs[app]


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: the lineage ends here, and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palisade_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_palisade_path", None):
            remove(df.sparkSession, path)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows that the driver has made, as a JSON literal: no Python worker and no RDD takes part.

    The caller answers for a bound on the number of rows.
    """
    kind = f"array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in T.StructType.fromDDL(schema))}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def folded(values: list, kind: str) -> Column:
    """A constant of the given type, written as one JSON literal that the optimizer folds: one call however many values."""
    return F.from_json(F.lit(json.dumps({"x": values})), f"struct<x:{kind}>")["x"]


def unit_hash(key: str | Column, seed: int) -> Column:
    """A number in (0, 1) that is a function of the key's text and the seed: 52 bits of MD5, which SQL engines share."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{WS}]+")), F.lit(0)).cast("long")
