"""What a worker holds at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import common


def held(session, rows=5000):
    """The largest text buffer that Python gets of rows of 1,000 bytes."""

    def look(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).buffers()[2].size])], names=["size"])

    docs = session.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    return common.arrow_map(docs, look, "size long").agg(F.max("size")).first()[0]


def test_few_rows_are_sent_at_once(spark):
    """A lot is a slice of what was sent, which lies in memory whole: 5 MB of 5,000 rows before."""
    fresh = spark.newSession()
    assert held(fresh) <= 2 * 1000 * common.BATCH_ROWS


def test_a_number_of_rows_that_was_set_stays(spark):
    own = spark.newSession()
    own.conf.set(common.SENT_ROWS, "4000")
    assert held(own) >= 4000 * 1000 and own.conf.get(common.SENT_ROWS) == "4000"
