"""Table functions against the DataFrame path."""

import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import segments, table_functions
from sparrowmill.plans import registry


def test_segment_function(spark):
    docs = registry.event_captions(spark, "/root/testdata/sf0.001")
    table_functions.register(spark)
    docs.select("id", F.posexplode("captions").alias("n", "c")).select("id", "n", "c.*").repartition(5).createOrReplaceTempView("captions")
    order = lambda df: sorted(map(str, df.collect()))
    assert order(spark.sql("SELECT * FROM segment(TABLE(captions))")) == order(segments.segment_table(docs))
    assert order(spark.sql("SELECT * FROM segment(TABLE(SELECT * FROM captions WHERE id LIKE '%1'), kind => 'srt')")) == order(segments.segment_table(docs.where("id LIKE '%1'"), kind="srt"))
    assert spark.sql("SELECT * FROM segment(TABLE(SELECT * FROM captions LIMIT 0))").count() == 0
    for bad in ("segment(TABLE(SELECT id FROM captions))", "segment(TABLE(captions), kind => 'ass')"):
        with pytest.raises(Exception, match="lacks|vtt or srt"):
            spark.sql(f"SELECT * FROM {bad}").count()
