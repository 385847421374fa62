import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollmill.jobs import audit
from rollmill.jobs.suite import answer_suite, run_query
from rollmill.operators import aggregate as A
from rollmill.operators import gapfill, refresh, series
from rollmill.operators import rollup as R
from rollmill.sources import store
from rollmill.spec import And, Eq, MetricQuery, MetricTable, Or, RollupMeta

MT = MetricTable("m", "time", ("platform", "host"), ("cpu", "mem"), ("id",))
SCHEMA = "id long, time timestamp_ntz, platform string, host string, cpu double, mem double"
EPOCH = dt.datetime(1970, 1, 1)
FNS = ("mean", "sum", "count", "min", "max", "first", "last")


def at(s):
    return EPOCH + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def points(spark):
    """Four series: one stops, one starts late, one has a hole; nulls, duplicate times, random order."""
    rng, rows = random.Random(3), []
    for i, (p, h) in enumerate([("mac", "h1"), ("mac", "h2"), ("win", "h1"), ("win", "h2")]):
        for s in range(0, 3600, 7):
            if (i == 0 and s > 2000) or (i == 1 and s < 900) or (i == 2 and 1200 <= s < 1500):
                continue
            rows.append((len(rows), at(s - s % 14), p, h, rng.choice([None, rng.gauss(20, 5)]), rng.gauss(50, 9)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache()


def same(a, b):
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    for p, q in zip(x, y, strict=True):
        assert p == pytest.approx(q, abs=1e-9, nan_ok=True) if all(isinstance(v, (int, float)) for v in p) else [v for v in p if not isinstance(v, float)] == [v for v in q if not isinstance(v, float)]
        assert [v for v in p if isinstance(v, float)] == pytest.approx([v for v in q if isinstance(v, float)], abs=1e-9)


@pytest.mark.parametrize("tags", [(), ("platform",), ("host",), ("platform", "host")])
@pytest.mark.parametrize("window", [60, 180, 600])
def test_an_answer_from_a_rollup_is_the_answer_from_raw(points, tags, window):
    r = R.build_rollup(points, MT, 60, MT.tags, fns=FNS)
    got = R.finalize(R.regroup_downsample(R.slice_rollup(r, 600, 3000), tags, window), FNS)
    same(got, A.bucket_agg(A.in_time(points, MT, 600, 3000), MT, window, tags, FNS))


def test_regroup_and_downsample_commute(points):
    r = R.build_rollup(points, MT, 60, MT.tags, fns=FNS)
    one = R.finalize(R.downsample(R.regroup(r, ("host",)), 300), FNS)
    same(one, R.finalize(R.regroup(R.downsample(r, 300), ("host",)), FNS))


@pytest.mark.parametrize(("old", "new"), [((600, 1800), (600, 3000)), ((630, 1790), (0, 1790)), ((630, 1790), (300, 3001))])
def test_extending_is_building_over_the_longer_range(points, old, new):
    r = R.build_rollup(points, MT, 60, MT.tags, fns=FNS, start=old[0], end=old[1])
    wide = refresh.extend(r, points, new_start=new[0] if new[0] != old[0] else None, new_end=new[1] if new[1] != old[1] else None)
    same(R.finalize(wide, FNS), R.finalize(R.build_rollup(points, MT, 60, MT.tags, fns=FNS, start=new[0], end=new[1]), FNS))
    assert (wide.meta.start, wide.meta.end) == new


def test_late_points_merge(points):
    late = F.col("id") % 3 == 0
    r = R.build_rollup(points.where(~late), MT, 60, MT.tags, fns=FNS)
    delta = R.build_rollup(points.where(late), MT, 60, MT.tags, fns=FNS)
    same(R.finalize(refresh.merge_states(r, delta.df), FNS), A.bucket_agg(points, MT, 60, MT.tags, FNS))


def test_order_and_partitions_do_not_matter(points):
    same(A.bucket_agg(points.repartition(7), MT, 300, ("host",), FNS), A.bucket_agg(points.coalesce(1).orderBy("cpu"), MT, 300, ("host",), FNS))


def test_worked_example(spark):
    """Slice, regroup to means, downsample (times shifted by one so that windows align)."""
    mt = MetricTable("m", "time", ("s",), ("v",))
    one, two = [5, 6, 10, 7], [7, 4, 16, 4]
    rows = [(at(t + 4), s, float(v)) for s, vs in (("a", one), ("b", two)) for t, v in enumerate(vs)] + [(at(1), "a", 99.0), (at(9), "b", 99.0)]
    r = R.slice_rollup(R.build_rollup(spark.createDataFrame(rows, "time timestamp_ntz, s string, v double"), mt, 1, ("s",)), 4, 8)
    means = R.finalize(R.regroup(r, ()), ("mean",)).orderBy("bucket").collect()
    assert [x.mean_v for x in means] == [6, 5, 13, 5.5]
    assert [x.mean_v for x in R.answer(r, "mean", 2, (), start=4, end=8).orderBy("bucket").collect()] == [5.5, 9.25]
    assert [x.mean_v for x in R.answer(r, "mean", 2, (), start=4, end=8, combine="values").orderBy("bucket").collect()] == [5.5, 9.25]


def test_what_a_rollup_serves():
    mean = RollupMeta("m", 60, ("host", "platform"), ("mean",), ("v",))
    assert [R.serves(mean, t, w, f) for t, w, f in [(("host", "platform"), 60, "mean"), (("platform",), 180, "mean"), ((), 60, "mean"), (("region",), 60, "mean"), (("platform",), 90, "mean"), (("platform",), 30, "mean"), (("platform",), 60, "max")]] == [True, True, True, False, False, False, False]
    median = RollupMeta("m", 60, ("host", "platform"), ("median",), ("v",))
    assert R.serves(median, ("platform", "host"), 60, "median") and not R.serves(median, ("platform",), 60, "median")


def test_unserved_questions_go_to_raw_or_fail(points):
    r = R.build_rollup(points, MT, 60, MT.tags)
    same(R.answer(r, "median", 300, ("host",), raw=points), A.bucket_agg(points, MT, 300, ("host",), ("median",)))
    with pytest.raises(ValueError, match="does not serve"):
        R.answer(r, "median", 300, ("host",))
    with pytest.raises(ValueError):
        R.downsample(r, 90)
    with pytest.raises(ValueError):
        R.regroup(r, ("region",))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_full_hit_has_one_exchange(spark, points, tmp_path):
    store.save_rollup(R.build_rollup(points, MT, 60, MT.tags), str(tmp_path / "r"))
    r = store.load_rollup(spark, str(tmp_path / "r"), MT)
    assert _plan(R.answer(r, "mean", 180, ("platform",), start=600, end=3000)).count("Exchange hashpartitioning") == 1
    assert "Exchange" not in _plan(R.answer(r, "mean", 60, MT.tags, start=600, end=3000))


def test_filters_reach_the_scan(spark, points, tmp_path):
    points.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    q = MetricQuery("m", ("cpu",), "mean", 60, ("platform",), (Or(Eq("platform", "mac"), Eq("platform", "win")),), 600, 3000)
    plan = _plan(run_query(df, MT, q))
    assert "In(platform" in plan and "GreaterThanOrEqual(time" in plan and "LessThan(time" in plan
    assert "mem" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_brackets_of_or_hold(points):
    tree = And(Or(Eq("host", "h1"), Eq("platform", "win")), Eq("host", "h2"))
    assert {(r.platform, r.host) for r in A.apply_filters(points, [tree]).collect()} == {("win", "h2")}


def test_open_and_half_open_bounds(points):
    times = lambda b: {r.time for r in A.in_time(points, MT, 14, 42, b).collect()}
    assert times("half_open") == {at(14), at(28)} and times("open") == {at(28)}


def test_suite_answers_equal_single_answers(points):
    either = (Or(Eq("platform", "mac"), Eq("platform", "win")),)
    qs = {"a": MetricQuery("m", ("cpu",), "mean", 60, MT.tags, either, 600, 3000), "b": MetricQuery("m", ("cpu", "mem"), "mean", 180, ("platform",), either, 0, 3600), "c": MetricQuery("m", ("mem",), "max", 120, (), (), 1200, 2400), "d": MetricQuery("m", ("mem",), "median", 120, (), (), 1200, 2400)}
    for name, df in answer_suite(points, MT, qs).items():
        same(df, run_query(points, MT, qs[name]))


def test_saved_rollups_replace_only_touched_dates(spark, points, tmp_path):
    more = points.withColumn("time", F.col("time") + F.make_dt_interval(days=F.lit(1)))
    both = points.unionByName(more)
    path = str(tmp_path / "r")
    store.save_rollup(R.build_rollup(both, MT, 60, MT.tags), path)
    store.save_rollup(R.build_rollup(more.where("host = 'h1'"), MT, 60, MT.tags, start=86400, end=2 * 86400), path)
    same(R.finalize(store.load_rollup(spark, path, MT), ("mean",)), A.bucket_agg(points.unionByName(more.where("host = 'h1'")), MT, 60, MT.tags))


@pytest.mark.parametrize(("start", "end", "n_head", "n_tail"), [(700, 1300, 6, 0), (940, 1300, 0, 0), (1000, 1500, 0, 3), (1000, 1360, 0, 0)])
def test_edges(spark, start, end, n_head, n_tail):
    df = spark.createDataFrame([(at(t), "a", 1.0) for t in range(1000, 1301, 60)], "bucket timestamp_ntz, s string, v double")
    got = {(r.bucket - EPOCH).total_seconds(): r.v for r in gapfill.fill_edges(df, ("s",), start, end, 60).collect()}
    assert sorted(t for t, v in got.items() if v is None) == [1000 - 60 * i for i in range(n_head, 0, -1)] + [1300 - (1300 - 1000) % 60 + 60 * i for i in range(1, n_tail + 1)]


def test_grid(spark):
    df = spark.createDataFrame([(at(60), "a", 3, 1.0), (at(180), None, 1, 2.0)], "bucket timestamp_ntz, s string, count_v long, mean_v double")
    rows = gapfill.fill_grid(df, ("s",), 30, 200, 60, count_zero=True).collect()
    assert {(r.s, (r.bucket - EPOCH).seconds): (r.count_v, r.mean_v) for r in rows} == {("a", 0): (0, None), ("a", 60): (3, 1.0), ("a", 120): (0, None), ("a", 180): (0, None), (None, 0): (0, None), (None, 60): (0, None), (None, 120): (0, None), (None, 180): (1, 2.0)}
    with pytest.raises(ValueError, match="more than 3"):
        gapfill.fill_grid(df, ("s",), 30, 200, 60, max_rows=3)


def test_index(spark):
    df = spark.createDataFrame([(1, ["platform=mac", "host=h1"], "mean", "x"), (2, ["platform=mac", "host=h2"], "max", "x"), (3, ["platform=win", "host=h1"], None, "x")], "id long, filter array<string>, aggregation string, other string")
    ix = series.index_build(df, "id").cache()
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(series.search_word(ix, "filter", "platform=mac")) == [1, 2]
    assert ids(series.search_all(ix, "filter", ["platform=mac", "host=h1"])) == [1]
    assert ids(series.search_tree(ix, Or(Eq("host", "h2"), Eq("platform", "win")))) == [2, 3]
    assert ids(series.search_tree(ix, And(Eq("host", "h1"), Or(Eq("platform", "win"), Eq("platform", "mac"))))) == [1, 3]
    assert ids(series.match(ix, {"filter": ["host=h1"], "aggregation": "mean"})) == [1]
    assert ix.where("type = 'other'").count() == 0


def test_catalog_of_series(spark):
    df = spark.createDataFrame([(at(60), "a"), (at(0), "a"), (at(60), "a"), (at(0), "b")], "bucket timestamp_ntz, s string")
    rows = {r.s: r for r in series.series_catalog(df, ("s",)).collect()}
    assert (rows["a"].second_last, rows["a"].buckets, rows["a"].series) == (at(0), 2, "s=a")
    assert rows["b"].second_last is None


def test_traces_and_latencies(spark):
    df = spark.createDataFrame([([{"a": 1.0, "b": 4.0}],), ([{"a": 3.0}],), ([{"a": 8.0}],)], "traces array<map<string,double>>")
    assert {(r.position, r.op): (r.mean_s, r.median_s, r.n) for r in audit.trace_collate(df).collect()} == {(0, "a"): (4.0, 3.0, 3), (0, "b"): (4.0, 4.0, 1)}
    runs = spark.createDataFrame([("q", "raw", 10.0), ("q", "raw", 20.0), ("q", "raw", 90.0), ("q", "cached", 2.0)], "query string, mode string, s double")
    assert tuple(audit.latency_compare(runs).first()) == ("q", 20.0, 2.0, 0.9)


def test_audit_sees_differences(spark):
    schema = "bucket timestamp_ntz, s string, v double"
    a = spark.createDataFrame([(at(0), "a", 1.0), (at(1), None, 2.0), (at(2), "a", 3.0), (at(5), "a", None)], schema)
    b = spark.createDataFrame([(at(0), "a", 1.0), (at(1), None, 2.5), (at(3), "a", 3.0), (at(5), "a", 1.0)], schema)
    r = audit.audit_rollup(a, b, ("s",), ("v",)).first()
    assert (r.rows, r.missing, r.extra, r.differing, r.max_abs) == (5, 1, 1, 2, 0.5)


def test_gaps_without_a_grid(spark):
    """No join in the plan; repeated buckets stay, buckets outside the range tell of their series, one series without tags."""
    at_ = at
    df = spark.createDataFrame([(at_(60), "a", 1), (at_(60), "a", 2), (at_(240), "a", 3), (at_(900), "b", 4), (at_(70), None, 5)], "bucket timestamp_ntz, s string, count_v int")
    out = gapfill.fill_grid(df, ("s",), 0, 300, 60, count_zero=True)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.s or "", (r.bucket - EPOCH).seconds // 60, r.count_v) for r in out.collect()))
    assert got == sorted([("a", k, v) for k, v in ((0, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 3))] + [(s, k, 0) for s in ("b", "") for k in range(5)])
    one = df.where("s = 'a' AND count_v > 1").drop("s")
    assert [r.count_v for r in gapfill.fill_grid(one, (), 0, 300, 60).orderBy("bucket").collect()] == [None, 2, None, None, 3]
    assert [r.count_v for r in gapfill.fill_grid(one.limit(0), (), 0, 120, 60).collect()] == [None, None]
    assert gapfill.fill_grid(df, ("s",), 120, 120, 60).count() == 0
