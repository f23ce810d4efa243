"""Texts come to Python tasks in batches of bounded size, and a lower bound that was set stays."""

from pyspark.sql import functions as F

from stationflow.llm.batches import BATCH_BYTES, in_small_batches

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_small_and_rows_whole(spark):
    before = spark.conf.get(SETTING)
    try:
        docs = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("abc"), 1000).alias("text"))

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        got = [r["n"] for r in in_small_batches(docs).mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 9000 and max(got) * 3000 <= 2 * BATCH_BYTES
        for value, kept in (("1000", "1000"), ("1g", str(BATCH_BYTES))):
            spark.conf.set(SETTING, value)
            in_small_batches(docs)
            assert spark.conf.get(SETTING) == kept
    finally:
        spark.conf.set(SETTING, before)
