"""How much text a Python task is handed at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches end at BATCH_BYTES, or earlier if a lower plain number was set.

    A batch of 10,000 rows of text is held several times over, in the JVM's direct memory and in the
    Python worker; neither gives it back. A text that is longer alone still comes whole.
    """
    conf = docs.sparkSession.conf
    now = conf.get(_SETTING).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_SETTING, str(BATCH_BYTES))
    return docs
