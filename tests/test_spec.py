import pytest
from pyspark.sql import functions as F

from rollmill.functions import columns as C
from rollmill.spec import And, Eq, MetricQuery, MetricTable, Or, filter_from, fingerprint, resolve_relative, seconds


@pytest.mark.parametrize(("text", "s"), [("30s", 30), ("10m", 600), ("2h", 7200), ("1d", 86400), ("1w", 604800), ("1y", 31536000), (60, 60)])
def test_durations(text, s):
    assert seconds(text) == s


@pytest.mark.parametrize("text", ["10x", "m", "", "1.5h", "10 m"])
def test_unknown_durations_are_errors(spark, text):
    with pytest.raises(ValueError):
        seconds(text)
    assert spark.createDataFrame([(text,)], "t string").select(C.duration_seconds(F.col("t"))).first()[0] is None


def test_fingerprints_ignore_order():
    a, b, c = Eq("x", 1), Eq("y", 2), Eq("z", 3)
    assert fingerprint([Or(a, b)]) == fingerprint([Or(b, a)])
    assert fingerprint([And(a, Or(b, c)), c]) == fingerprint([c, And(Or(c, b), a)])
    assert fingerprint([Or(a, b)]) != fingerprint([And(a, b)])


def test_documents():
    doc = {"table": "m", "measurements": ["v"], "groupKeys": ["host"], "range": {"start": 1, "end": 2}, "relativeRange": None, "filters": [{"type": "and", "filter": [{"key": "a", "value": "b"}, {"type": "or", "filter": [{"key": "c", "value": "d"}, {"key": "e", "value": "f"}]}]}], "aggregate": {"timeWindow": "2m", "aggFunc": "mean"}}
    q = MetricQuery.from_json(doc)
    assert (q.window, q.fn, q.start, q.end, q.create_empty) == (120, "mean", 1, 2, False)
    assert q.filters == (And(Eq("a", "b"), Or(Eq("c", "d"), Eq("e", "f"))),)
    relative = MetricQuery.from_json(doc | {"range": None, "relativeRange": {"fr": "300m", "to": None}}).at(100_000)
    assert (relative.start, relative.end) == (82_000, 100_000)
    assert resolve_relative("1h", "10m", 10_000) == (6400, 9400)
    with pytest.raises(ValueError):
        filter_from({"type": "xor", "filter": []})
    with pytest.raises(ValueError, match="known: mean"):
        MetricQuery("m", ("v",), "mode", 60)


def test_tables_are_checked(spark):
    mt = MetricTable("m", "t", ("host",), ("v",))
    with pytest.raises(ValueError, match="no column v"):
        mt.check(spark.createDataFrame([], "t timestamp, host string"))
    with pytest.raises(ValueError, match="not a timestamp"):
        mt.check(spark.createDataFrame([], "t string, host string, v double"))
    with pytest.raises(ValueError, match="no field w"):
        mt.chosen(["w"])


GOLDEN = [
    ((1000, 2000), ("hit", None, None)), ((1200, 1800), ("hit", None, None)), ((950, 2000), ("hit", None, None)), ((1000, 2050), ("hit", None, None)),
    ((500, 2000), ("start", 500, 1000)), ((1000, 2500), ("end", 2000, 2500)), ((500, 2500), ("full", 500, 2500)), ((2100, 2500), ("full", 2100, 2500)),
    ((100, 900), ("full", 100, 900)), ((500, 2030), ("start", 500, 1000)), ((970, 2500), ("end", 2000, 2500)),
]


def test_missing_ranges(spark):
    df = spark.createDataFrame([(i, *q) for i, (q, _) in enumerate(GOLDEN)], "i int, s long, e long")
    m = C.missing_range(F.col("s"), F.col("e"), F.lit(1000), F.lit(2000), F.lit(60))
    got = [tuple(r.m) for r in df.select("i", m.alias("m")).orderBy("i").collect()]
    assert got == [want for _, want in GOLDEN]


def test_series_keys_leave_internal_labels_out(spark):
    df = spark.createDataFrame([("h1", "linux", "cpu", "x")], "host string, platform string, _field string, _start string")
    assert df.select(C.series_key(df.columns)).first()[0] == "_field=cpu,host=h1,platform=linux"
