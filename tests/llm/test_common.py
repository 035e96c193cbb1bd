import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from palimpsest.llm.common import ARROW_BYTES, light_batches, stage

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])


def test_staged_texts_go_to_python_in_light_batches(spark):
    before, long = spark.conf.get(BATCH), 1 << 20
    texts = spark.range(0, 24, 1, 1).select(F.lpad(F.col("id").cast("string"), long, "x").alias("text"))
    made = stage(texts.mapInArrow(sizes, "n bigint, bytes bigint"), "test-sizes").collect()
    assert sum(r.n for r in made) == 24
    assert max(r.bytes for r in made) <= ARROW_BYTES + 2 * long
    # narrow rows are not split
    narrow = stage(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n bigint, bytes bigint"), "test-sizes").collect()
    assert [r.n for r in narrow] == [5000]
    assert spark.conf.get(BATCH) == before


def test_batch_size_is_put_back_and_a_lower_one_stays(spark):
    before = spark.conf.get(BATCH)
    try:
        for asked, within in (("64m", str(ARROW_BYTES)), ("1g", str(ARROW_BYTES)), ("100k", "100k"), ("2000", "2000")):
            spark.conf.set(BATCH, asked)
            held = spark.conf.get(BATCH)
            with pytest.raises(KeyError), light_batches(spark):
                assert spark.conf.get(BATCH).rstrip("b") == within.rstrip("b")
                raise KeyError
            assert spark.conf.get(BATCH) == held
    finally:
        spark.conf.set(BATCH, before)


def test_last_stage_of_the_pipeline_calls_python_in_light_batches_too(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some text {i}", "en", "s") for i in range(9)], "doc_id bigint, text string, lang string, source string")
    out = P.tokens(spark, docs, str(tmp_path))
    assert out.count() == 9 and "MapInArrow" not in out._jdf.queryExecution().toString()
