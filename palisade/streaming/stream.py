"""The same analysis over a stream of packages. It keeps no state, so a stream's results are those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.plans.pipeline import analyze
from palisade.sources.tables import CORPUS, from_texts


def read_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """JSON lines (id, skill_name, content, label, attack) as they arrive in a folder."""
    return spark.readStream.schema(CORPUS).option("maxFilesPerTrigger", files_a_batch).json(folder)


def analyze_stream(rows: DataFrame) -> DataFrame:
    return analyze(from_texts(rows, F.col("id"), F.col("content")))


def start(rows: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write results as JSON lines; the file sink and the checkpoint make each row appear once, whatever is lost on the way."""
    w = analyze_stream(rows).writeStream.format("json").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
