"""rollup_union over event types that it does not name."""

from oracle import compare, sql_rows
from pyspark.sql import functions as F

from rollmill.queries import ORACLES, QUERIES


def test_other_and_missing_types_are_in_the_union(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "error", "new kind").otherwise(F.col("event_type"))
    events.withColumn("event_type", kind).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert compare(QUERIES["rollup_union"](spark, str(tmp_path)).toPandas(), sql_rows(ORACLES["rollup_union"], str(tmp_path))) is None
