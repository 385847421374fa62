"""Medians of large groups against the built-in one, and the bitmap index."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollmill.operators import aggregate as A
from rollmill.operators import series
from rollmill.operators.median import exact_median
from rollmill.spec import And, Eq, MetricTable, Or

MT = MetricTable("m", "time", ("host",), ("u", "v"))


def table(spark, rows):
    return spark.createDataFrame(rows, "time timestamp_ntz, host string, u double, v double")


@pytest.mark.parametrize(("few", "bins"), [(10_000, 1024), (40, 256)])
def test_equals_the_built_in_median(spark, few, bins):
    r = random.Random(few)
    shapes = {"same": lambda: 2.5, "few": lambda: float(r.randrange(3)), "wide": lambda: r.choice([-1, 1]) * 10.0 ** r.randrange(-6, 7), "even": lambda: r.uniform(-1, 1), "odd": lambda: r.choice([1.0, float("nan"), float("inf")]), None: lambda: r.gauss(0, 1)}
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=r.randrange(120)), host, make(), None if r.random() < 0.3 or host == "few" else make()) for host, make in shapes.items() for _ in range(r.randrange(250, 402))]
    df = table(spark, rows).repartition(5)
    want = A.bucket_agg(df, MT, 3600, ("host",), ("median",))
    got = exact_median(df, MT, 3600, ("host",), few=few, bins=bins)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_large_groups_are_never_in_one_place(spark):
    df = table(spark, [(datetime(2024, 1, 1), "a", float(i * 7919 % 5000), 1.0) for i in range(5000)])
    got = exact_median(df, MT, 3600, (), few=50)
    assert got.collect() == [(datetime(2024, 1, 1), 2499.5, 1.0)]
    assert exact_median(df.limit(0), MT, 3600, ()).count() == 0


def test_a_tree_is_one_scan_and_one_exchange(spark, tmp_path):
    ids = spark.range(-100, 3000).select("id", F.array(F.concat(F.lit("a="), F.col("id") % 3), F.concat(F.lit("b="), F.col("id") % 5)).alias("filter"), F.lit("mean").alias("aggregation"))
    series.index_build(ids, "id").write.parquet(str(tmp_path / "ix"))
    index = spark.read.parquet(str(tmp_path / "ix"))
    assert index.count() < series.postings(index).count() / 10
    tree = And(Or(Eq("a", 0), Eq("a", 1)), Or(Eq("b", 2), And(Eq("a", 1), Eq("b", 3)), Eq("b", 99)))
    found = series.search_tree(index, tree)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    mod = lambda x, n: x - n * int(x / n)  # noqa: E731  the sign of the number
    want = sorted(i for i in range(-100, 3000) if mod(i, 3) in (0, 1) and (mod(i, 5) == 2 or (mod(i, 3) == 1 and mod(i, 5) == 3)))
    assert sorted(r.id for r in found.collect()) == want
    assert sorted(map(tuple, series.postings(index).where("type = 'aggregation'").select("word", "id").collect())) == [("mean", i) for i in range(-100, 3000)]


def test_the_approximate_median_is_off_by_few_ranks(spark):
    df = table(spark, [(datetime(2024, 1, 1), "a", float(i * 7919 % 30011), None) for i in range(30011)])
    got = A.bucket_agg(df, MT, 3600, ("host",), ("approx_median",)).first()
    assert abs(got.approx_median_u - 15005) <= 4 and got.approx_median_v is None
