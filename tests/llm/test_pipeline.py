import pyarrow as pa

import corpus_pipeline
from lorespark.session import BATCH_BYTES

FOLDER = "/root/testdata/sf0.001"


def test_texts_travel_in_batches_of_bounded_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    docs = spark.range(600).selectExpr("id doc_id", "repeat('word ', 10000) text").coalesce(1)
    most = lambda: max(r.n for r in docs.mapInArrow(sizes, "n long").collect())
    spark.conf.unset(BATCH_BYTES)
    try:
        assert most() > 20 << 20
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(BATCH_BYTES)
            stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
            if name != "mixing":  # no Python there
                assert spark.conf.get(BATCH_BYTES) == str(4 << 20)
        assert most() < 5 << 20
        spark.conf.set(BATCH_BYTES, "1000000")
        corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
        assert spark.conf.get(BATCH_BYTES) == "1000000"
    finally:
        spark.conf.unset(BATCH_BYTES)
