"""audit_store over values that a double plus 1 takes off their declared places, without values and without such points."""

import pytest
from oracle import compare, sql_rows
from pyspark.sql import functions as F

from rollmill.queries import ORACLES, QUERIES


@pytest.mark.parametrize(("value", "kept"), [("1.43D", "true"), ("if(event_id % 3 = 0, null, 560.21D)", "true"), ("-value", "true"), ("value", "event_type != 'view'"), ("value", "false")])
def test_what_is_off_is_found_whatever_the_values(spark, tmp_path, value, kept):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("value", F.expr(value)).where(kept).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = QUERIES["audit_store"](spark, str(tmp_path)), sql_rows(ORACLES["audit_store"], str(tmp_path))
    assert compare(got.toPandas(), want) is None
    exact = lambda df: sorted(zip(df["measure"], df["stored"], df["fresh"], strict=True))
    assert exact(got.toPandas()) == exact(want) and (len(want) > 0) == (kept == "true")
