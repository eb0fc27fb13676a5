"""From packages to results, and the command line."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import linear
from palisade.operators.scan import scan
from palisade.operators.score import results, score
from palisade.sources.directory import load_documents
from palisade.sources.tables import write_results


def analyze(docs: DataFrame, fast: bool = False, model_score: Column | None = None, prose_score: Column | None = None) -> DataFrame:
    """skill_id, verdict, confidence, category, evidence of every document."""
    return results(score(scan(docs), fast, model_score, prose_score))


def analyze_with_model(docs: DataFrame, model: linear.Model | None, fast: bool = False) -> DataFrame:
    """analyze() with the scores of a linear text model; without one, by rules alone."""
    if model is None:
        return analyze(docs, fast)
    scores = linear.predict(docs, model).withColumnRenamed("ml_score", "_p")
    return analyze(docs.join(scores, "skill_id"), fast, F.col("_p"))


def main(argv: list[str] | None = None) -> int:
    """Options come from the command line, else from INPUT_DIR, OUTPUT_PATH and MODEL_PATH in the environment."""
    p = argparse.ArgumentParser(description="Classify packages of text files by static analysis.")
    p.add_argument("--input", default=os.environ.get("INPUT_DIR", "/data/skills"), help="folder whose sub-folders are the packages")
    p.add_argument("--output", default=os.environ.get("OUTPUT_PATH", "/output/results.jsonl"), help="folder for the JSON lines")
    p.add_argument("--model", default=os.environ.get("MODEL_PATH"), help="a saved linear text model (optional)")
    p.add_argument("--fast", action="store_true", help="leave out the mismatch step")
    p.add_argument("--one-file", action="store_true", help="one output file instead of files in order")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("palisade").getOrCreate()
    out = analyze_with_model(load_documents(spark, args.input), linear.load(spark, args.model) if args.model else None, args.fast)
    write_results(out, args.output, args.one_file)
    sys.stderr.write(f"wrote {spark.read.text(args.output).count()} result lines to {args.output}\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
