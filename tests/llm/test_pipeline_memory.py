"""What the pipeline holds at once, in executors and in the driver."""

import tracemalloc

import numpy as np

import corpus_pipeline
from palisade.llm import quality


def test_batches_of_stages_are_bounded_by_bytes(spark, tmp_path):
    """A batch of 10 000 long texts takes the executors' memory several times."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.getAll.get(setting)
    spark.conf.unset(setting)
    seen = spark.sparkContext.accumulator(0)
    try:
        spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 500) as text", "'en' as lang", "'web' as source", "5000L as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1)
        corpus_pipeline.pack_sequences(spark, docs.limit(1), str(tmp_path))

        def sizes(batches):
            for b in batches:
                seen.add(1)
                yield b

        docs.mapInArrow(sizes, docs.schema).count()
        assert seen.value >= 4  # some 12 MB of texts: one batch by rows alone
        spark.conf.set(setting, "5000000")
        corpus_pipeline.pack_sequences(spark, docs.limit(1), str(tmp_path))
        assert spark.conf.get(setting) == "5000000"
    finally:
        spark.conf.unset(setting)
        if was:
            spark.conf.set(setting, was)


def test_word_vectors_need_little_more_than_the_table():
    sums = np.arange(quality.BUCKETS * (quality.DIM + 1), dtype=np.float64).reshape(quality.BUCKETS, -1) % 1001 / 2
    tracemalloc.start()
    try:
        got = quality.word_vectors(sums)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    rng = np.random.default_rng(1)
    at = np.argsort(rng.random((quality.BUCKETS, quality.DIM)), axis=1)[:, :4]
    plain = np.zeros((quality.BUCKETS, quality.DIM), np.float32)
    np.put_along_axis(plain, at, rng.choice(np.float32([-0.5, 0.5]), (quality.BUCKETS, 4)), axis=1)
    plain = (plain + sums[:, : quality.DIM] / np.maximum(1, sums[:, quality.DIM :])).astype(np.float32)
    assert np.array_equal(got, plain)
    assert peak < 2.5 * got.nbytes
