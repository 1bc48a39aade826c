"""What Python workers hold beside an executor's heap, between tasks and within one."""

import pyarrow as pa
import pytest
from barlake.llm import packing, suffix_dedup
from barlake.llm.common import trimmed
from barlake.llm.queries import tokenizer
from pyspark.sql import functions as F

ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_words_go_when_a_task_of_another_operator_ends():
    packing.encoder(*tokenizer()).ids("some words to remember")
    assert list(trimmed(iter, packing.encoder)([1])) == [1]
    assert len(packing.encoder(*tokenizer())) == 3  # packing's own tasks leave them
    assert list(trimmed(iter)([1])) == [1]
    assert packing.encoder.cache_info().currsize == 0


@pytest.mark.parametrize("before", ["10000", "300", "0"])
def test_passes_take_small_batches(spark, before):
    at_first = spark.conf.get(ROWS_A_BATCH)
    rows = spark.range(0, 5000, 1, 1)

    def sizes(batches):
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([k] * 4, pa.int64()) for k in (7, 8, n, 9)], ["core", "context", "uid", "code"])

    try:
        spark.conf.set(ROWS_A_BATCH, before)
        met = suffix_dedup.sort_out(rows.mapInArrow(sizes, suffix_dedup.ROWS))
        most, least = met.agg(F.max("uid"), F.min("uid")).first()
        assert 0 < least <= most <= 1000
        assert spark.conf.get(ROWS_A_BATCH) == before
    finally:
        spark.conf.set(ROWS_A_BATCH, at_first)
