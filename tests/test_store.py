"""The rollup store: what a save keeps and replaces, several rollups in a folder, answers from them; times in any session zone."""

import itertools
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollmill.functions import columns as C
from rollmill.jobs.serve import absorb, cover, serve
from rollmill.jobs.suite import answer_suite, run_query
from rollmill.operators import aggregate as A
from rollmill.operators import gapfill, refresh
from rollmill.operators import rollup as R
from rollmill.sources import store
from rollmill.spec import Eq, MetricQuery, MetricTable, Or, RollupMeta

MT = MetricTable("m", "time", ("host", "platform"), ("cpu",), places=3)
DAY, T = 86400, 1_700_006_400
EPOCH = datetime(1970, 1, 1)
SHAPE = (3600, MT.tags, (), ("mean", "max"))


@pytest.fixture(scope="module")
def points(spark):
    """Four days from T on, four series, in which days have hours without points."""
    rng = random.Random(3)
    rows = [(EPOCH + timedelta(seconds=T + s), h, p, round(rng.uniform(-50, 50), 3)) for s in range(0, 4 * DAY, 1700) for h in ("h1", "h2") for p in ("mac", "win") if rng.random() < 0.6]
    return spark.createDataFrame(rows, "time timestamp_ntz, host string, platform string, cpu double")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def built(points, start=None, end=None, window=3600):
    return R.build_rollup(points, MT, window, MT.tags, (), ("mean", "max"), start, end)


def held(spark, path):
    return rows(R.finalize(store.load_rollup(spark, path, MT), ("mean", "max")))


@pytest.mark.parametrize(("start", "end"), [(T + DAY + 13 * 3600, T + 2 * DAY + 5 * 3600), (T + DAY + 13 * 3600 + 600, T + 2 * DAY + 5 * 3600 + 60), (T - DAY, T + 3600), (T + 3 * DAY + 60, T + 6 * DAY), (None, T + 7200), (T + 7200, None)])
def test_a_part_saved_over_the_whole_loses_nothing(spark, points, tmp_path, start, end):
    path = str(tmp_path / "r")
    store.save_rollup(built(points, T, T + 4 * DAY), path)
    store.save_rollup(built(points, start, end), path)
    assert held(spark, path) == rows(R.finalize(built(points), ("mean", "max")))
    meta = store.load_rollup(spark, path, MT).meta
    assert meta.start == (None if start is None else min(T, start)) and meta.end == (None if end is None else max(T + 4 * DAY, end))


def test_what_a_part_no_longer_holds_goes(spark, points, tmp_path):
    path = str(tmp_path / "r")
    store.save_rollup(built(points, T, T + 4 * DAY), path)
    without = points.where(~((F.col("time") >= C.moment(T + DAY)) & (F.col("time") < C.moment(T + 2 * DAY))))
    store.save_rollup(built(without, T + DAY - 7200, T + 2 * DAY), path)
    assert held(spark, path) == rows(R.finalize(built(without), ("mean", "max")))


def test_gaps_other_shapes_and_doubly_partial_buckets_are_errors(spark, points, tmp_path):
    path = str(tmp_path / "r")
    store.save_rollup(built(points, T, T + DAY + 600), path)
    for bad in (built(points, T + 2 * DAY, T + 3 * DAY), built(points, T, T + DAY, 7200), built(points, T + DAY + 300, T + 2 * DAY)):
        with pytest.raises(ValueError):
            store.save_rollup(bad, path)


def test_an_extended_rollup_is_saved_to_its_own_path(spark, points, tmp_path):
    path = str(tmp_path / "r")
    store.save_rollup(built(points, T + DAY + 600, T + 2 * DAY + 900), path)
    store.save_rollup(refresh.extend(store.load_rollup(spark, path, MT), points, T, T + 4 * DAY), path)
    assert held(spark, path) == rows(R.finalize(built(points), ("mean", "max")))


def test_serving_from_a_folder(spark, points, tmp_path):
    root = str(tmp_path)
    either = Or(Eq("host", "h1"), Eq("host", "h2"))
    ask = lambda start, end, fn="mean", tags=("platform",), window=7200, filters=(either,): MetricQuery("m", ("cpu",), fn, window, tags, filters, start, end)
    kinds = []
    for q in (ask(T + DAY, T + 2 * DAY), ask(T + DAY, T + 2 * DAY), ask(T + DAY + 7200, T + 3 * DAY), ask(T, T + 3 * DAY, window=14400), ask(T, T + DAY, tags=("host",)), ask(T, T + DAY, fn="median"), ask(T, T + DAY, filters=()), ask(T, T + DAY, tags=(), window=7 * 7200)):
        got = serve(root, points, MT, q)
        low, high = q.start // q.window * q.window, -(-q.end // q.window) * q.window
        want = run_query(points, MT, q) if q.fn == "median" else run_query(points, MT, MetricQuery("m", q.fields, q.fn, q.window, q.tags, q.filters, low, high))
        assert rows(got.df) == rows(want), q
        kinds.append((got.kind, sum(b - a for a, b in got.read)))
    assert kinds == [("miss", DAY), ("hit", 0), ("extend", DAY), ("extend", DAY), ("miss", DAY), ("raw", 0), ("miss", DAY), ("extend", kinds[-1][1])]
    assert store.catalog(spark, root).count() == 3
    store.clear(spark, root)
    assert store.catalog(spark, root).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_s_zone(spark, zone):
    """The hours around changes of the clock in spring and autumn, and a time before 1970."""
    at = [1710054000, 1710055800, 1710057600, 1730609999, 1730613600, -3600, 0]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(x,) for x in at], "x long").select("x", C.moment(F.col("x")).alias("t"))
        got = df.select("x", F.col("t").cast("string").alias("t"), C.to_epoch(F.col("t")).alias("s"), (C.to_epoch(F.col("t"), "ns") / 10**9).cast("long").alias("n"), C.to_epoch(F.timestamp_seconds("x"), zoned=True).alias("z")).collect()
        assert [(r.s, r.n, r.z) for r in got] == [(x, x, x) for x in at]
        assert [datetime.fromisoformat(r.t) for r in got] == [EPOCH + timedelta(seconds=x) for x in at]
        start = 1710028800  # 2024-03-10, a day of 23 hours in New York
        raw = spark.createDataFrame([(EPOCH + timedelta(seconds=start + h * 3600), "a", 1.0) for h in (3, 5, 20)], "time timestamp_ntz, host string, cpu double")
        mt = MetricTable("m", "time", ("host",), ("cpu",))
        buckets = A.bucket_agg(raw, mt, 3600, ("host",), ("count",))
        grid = gapfill.fill_grid(buckets, ("host",), start, start + DAY, 3600)
        assert grid.count() == 24 and grid.where("count_cpu = 1").count() == 3
        assert rows(grid.select(F.min(F.col("bucket").cast("string")))) == [("2024-03-10 00:00:00",)]
        edges = gapfill.fill_edges(buckets, ("host",), start, start + DAY, 3600)
        assert edges.where("count_cpu is null").count() == 4 + 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# ---- snapshots ---------------------------------------------------------------------------------


def test_an_answer_taken_before_saves_still_reads_its_rows(spark, points, tmp_path):
    path = str(tmp_path / "r")
    store.save_rollup(built(points, T, T + 2 * DAY), path)
    taken = R.finalize(store.load_rollup(spark, path, MT), ("mean", "max"))
    store.save_rollup(built(points.where("host = 'h1'"), T + 3600, T + 4 * DAY), path)
    store.compact(spark, path)
    assert rows(taken) == rows(R.finalize(built(points, T, T + 2 * DAY), ("mean", "max")))
    assert rows(R.finalize(store.load_rollup(spark, path, MT, version=1), ("mean", "max"))) == rows(taken)


@pytest.mark.parametrize("step", ["_write", "_publish", "vacuum"])
def test_a_save_that_dies_at_any_step_leaves_one_of_both_states(spark, points, tmp_path, monkeypatch, step):
    path = str(tmp_path / "r")
    store.save_rollup(built(points, T, T + 2 * DAY), path)
    before = held(spark, path)

    real = getattr(store, step)

    def dies(*args, **kwargs):
        if step == "_write":
            real(*args, **kwargs)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, step, dies)
        with pytest.raises(KeyboardInterrupt):
            store.save_rollup(built(points, T + DAY, T + 4 * DAY), path)
    whole = rows(R.finalize(built(points, T, T + 4 * DAY), ("mean", "max")))
    assert held(spark, path) == (whole if step == "vacuum" else before)
    store.save_rollup(built(points, T + DAY, T + 4 * DAY), path)
    assert held(spark, path) == whole


def test_two_writers_at_once_both_count(spark, points, tmp_path, monkeypatch):
    """Another save commits between the read and the commit of this one, which starts anew."""
    path, real, other = str(tmp_path / "r"), store._publish, []
    store.save_rollup(built(points, T + DAY, T + 2 * DAY), path)

    def late(*args):
        if not other:
            other.append(True)
            store.save_rollup(built(points, T, T + DAY), path)
        return real(*args)

    monkeypatch.setattr(store, "_publish", late)
    store.save_rollup(built(points, T + 2 * DAY, T + 4 * DAY), path)
    assert held(spark, path) == rows(R.finalize(built(points, T, T + 4 * DAY), ("mean", "max")))
    monkeypatch.setattr(store, "_publish", lambda *a: False)
    with pytest.raises(store.Conflict):
        store.save_rollup(built(points, T, T + DAY), path)


def test_superseded_files_go_late(spark, points, tmp_path):
    path = str(tmp_path / "r")
    for k in range(3):
        store.save_rollup(built(points, T, T + (k + 1) * DAY), path)
    (tmp_path / "r" / "data" / "v=dead").mkdir()
    assert store.vacuum(spark, path) == 0 and len(store._versions(spark, path)) == 3
    whole = held(spark, path)
    assert store.vacuum(spark, path, keep=-60) > 0 and store._versions(spark, path) == [3]
    assert held(spark, path) == whole and len(list((tmp_path / "r" / "data").iterdir())) == 1


def test_large_periods_are_cut_by_size_and_read_whole(spark, points, tmp_path):
    path = str(tmp_path / "r")
    sizes = {f"spark.sql.adaptive.{k}": "2k" for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")}
    old = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        store.save_rollup(built(points.repartition(8), T, T + 4 * DAY, window=600), path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = list((tmp_path / "r" / "data").rglob("*.parquet"))
    assert len(files) > len({f.parent for f in files}) >= 4
    assert held(spark, path) == rows(R.finalize(built(points, window=600), ("mean", "max")))


# ---- late points -------------------------------------------------------------------------------


def test_late_points_reach_every_stored_rollup_once(spark, points, tmp_path):
    root = str(tmp_path)
    late = points.where("second(time) % 3 = 0")
    early = points.where("second(time) % 3 <> 0")
    ask = lambda fn, tags, filters, end=T + 2 * DAY: MetricQuery("m", ("cpu",), fn, 7200, tags, filters, T, end)
    asked = [ask("mean", ("host",), ()), ask("max", ("platform",), (Eq("host", "h1"),)), ask("sum", (), ())]
    for q in asked:
        serve(root, early, MT, q)
    assert absorb(root, late, MT, "b1") == 2
    files = {f for f in tmp_path.rglob("*.parquet")}
    assert absorb(root, late, MT, "b1") == 0 and {f for f in tmp_path.rglob("*.parquet")} == files
    for q in asked:
        got = serve(root, points, MT, q)
        assert got.kind == "hit" and rows(got.df) == rows(run_query(points, MT, q))
    grown = serve(root, points, MT, ask("mean", ("host",), (), T + 4 * DAY))
    assert rows(grown.df) == rows(run_query(points, MT, ask("mean", ("host",), (), T + 4 * DAY)))


def test_many_batches_are_folded_in_place(spark, points, tmp_path):
    path, n = str(tmp_path / "r"), store.WRITES + 3
    readers = []
    for k in range(n):
        assert store.merge_rollup(built(points.where(F.pmod(F.hash("time", "host"), F.lit(n)) == k)), path, "s", k)
        readers.append(store.load_rollup(spark, path, MT).df)
    assert max(len(v) for v in store.snapshot(spark, path).periods.values()) <= store.WRITES
    assert held(spark, path) == rows(R.finalize(built(points), ("mean", "max")))
    assert [bool(r.count()) for r in readers] == [True] * n  # all still read their files
    assert store.compact(spark, path) and not store.compact(spark, path)
    assert held(spark, path) == rows(R.finalize(built(points), ("mean", "max")))
    assert not store.merge_rollup(built(points), path, "s", n - 1)


# ---- several rollups ---------------------------------------------------------------------------


def test_a_cover_takes_the_fewest_rollups():
    r = random.Random(2)
    for _ in range(300):
        w = 10
        metas = [RollupMeta("m", r.choice([1, 2, 5, 10]), (), (), (), "", a if r.random() > 0.1 else None, a + r.randrange(1, 60)) for a in (r.randrange(0, 90) for _ in range(r.randrange(1, 6)))]
        got = cover(metas, 20, 80, w)
        assert [a for _, a, _ in got] + [80] == [20] + [b for _, _, b in got]
        has = lambda i, x: (metas[i].start is None or -(-metas[i].start // w) * w <= x) and x + w <= metas[i].end // w * w
        for i, a, b in got:
            for x in range(a, b, w):
                assert has(i, x) if i is not None else not any(has(j, x) for j in range(len(metas)))
        have = {x for x in range(20, 80, w) if any(has(j, x) for j in range(len(metas)))}
        least = next(n for n in range(len(metas) + 1) if any(all(any(has(j, x) for j in some) for x in have) for some in itertools.combinations(range(len(metas)), n)))
        assert len({i for i, _, _ in got if i is not None}) <= sum(i is not None for i, _, _ in got)
        assert sum(i is not None for i, _, _ in got) - sum(i is None for i, _, _ in got[1:-1]) <= least + 1


def test_answers_from_several_rollups_and_the_gap_between(spark, points, tmp_path):
    root = str(tmp_path)
    for start, end, window, tags in ((T, T + DAY, 1200, MT.tags), (T + 2 * DAY + 1800, T + 4 * DAY, 3600, ("host",))):
        r = R.build_rollup(points, MT, window, tags, (), ("mean", "max"), start, end)
        store.save_rollup(r, store.place(root, r.meta))
    q = MetricQuery("m", ("cpu",), "mean", 7200, ("host",), (), T, T + 4 * DAY)
    got = serve(root, points, MT, q)
    assert got.kind == "extend" and sum(b - a for a, b in got.read) < 1.1 * DAY and len(got.parts) > 1
    assert rows(got.df) == rows(run_query(points, MT, q))
    again = serve(root, points, MT, q)
    assert again.kind == "cover" and not again.read and rows(again.df) == rows(run_query(points, MT, q))


def test_empty_windows_from_store_and_suite(spark, points, tmp_path):
    some = points.where("hour(time) < 5")
    q = MetricQuery("m", ("cpu",), "mean", 3600, ("host",), (), T, T + 2 * DAY, create_empty=True)
    want = rows(run_query(some, MT, q))
    assert len(want) == 96 and any(r[2] is None for r in want)
    assert rows(serve(str(tmp_path), some, MT, q).df) == want == rows(serve(str(tmp_path), some, MT, q).df)
    with answer_suite(some, MT, {"a": q}) as answers:
        assert rows(answers["a"]) == want and answers.cached
    assert not answers.cached


# ---- times -------------------------------------------------------------------------------------


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_saves_answers_and_extensions_in_any_zone(spark, points, tmp_path, zone, kind):
    """Every bucket is kept and every answer equals the one from raw points, with both kinds of times."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        raw = points.withColumn("time", F.timestamp_seconds(C.to_epoch(F.col("time"))) if kind == "timestamp" else F.col("time"))
        assert raw.schema["time"].dataType.typeName() == kind
        shown = lambda df: rows(df.withColumn("bucket", C.to_epoch(F.col("bucket"), zoned=C.is_zoned(df))))
        path = str(tmp_path / "r")
        whole = shown(R.finalize(built(raw), ("mean", "max")))
        store.save_rollup(built(raw), path)
        store.save_rollup(built(raw, T + DAY + 7 * 3600, T + DAY + 12 * 3600), path)
        assert shown(R.finalize(store.load_rollup(spark, path, MT), ("mean", "max"))) == whole
        low, high = T + 3 * 3600, T + 2 * DAY + 5 * 3600
        direct = shown(A.bucket_agg(A.in_time(raw, MT, low, high), MT, 3600, MT.tags, ("mean",)))
        assert shown(R.answer(store.load_rollup(spark, path, MT, start=low, end=high), "mean", 3600, MT.tags, start=low, end=high)) == direct
        grown = refresh.extend(built(raw, T + DAY + 900, T + 2 * DAY + 900), raw, T + 1800, T + 4 * DAY)
        assert shown(R.finalize(grown, ("mean", "max"))) == shown(R.finalize(built(raw, T + 1800, T + 4 * DAY), ("mean", "max")))
        q = MetricQuery("m", ("cpu",), "max", 7200, ("host",), (), T, T + 3 * DAY)
        for _ in range(2):
            assert shown(serve(str(tmp_path / "root"), raw, MT, q).df) == shown(run_query(raw, MT, q))
        assert shown(serve(str(tmp_path / "root"), raw, MT, MetricQuery("m", ("cpu",), "max", 7200, ("host",), (), T - DAY, T + 4 * DAY)).df) == shown(run_query(raw, MT, MetricQuery("m", ("cpu",), "max", 7200, ("host",), (), T - DAY, T + 4 * DAY)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 0.0001, 1e17])
def test_values_that_are_not_of_the_declared_places_are_errors(spark, value):
    df = spark.createDataFrame([(EPOCH, "a", "b", 1.5), (EPOCH, "a", "b", value)], "time timestamp_ntz, host string, platform string, cpu double")
    for made in (A.bucket_agg(df, MT, 60, ("host",), ("mean",)), R.build_rollup(df, MT, 60, ("host",)).df):
        with pytest.raises(Exception, match="declares 3 places"):
            made.collect()
    loose = MetricTable("m", "time", ("host",), ("cpu",))
    got = R.finalize(R.build_rollup(df, loose, 60, ("host",)), ("mean", "count")).first()
    direct = A.bucket_agg(df, loose, 60, ("host",), ("mean", "count")).first()
    assert str(got) == str(direct) and got.count_cpu == 2


# ---- audits ------------------------------------------------------------------------------------


def test_an_audit_reads_only_periods_that_differ(spark, points, tmp_path):
    from rollmill.jobs.audit import audit_store

    path = str(tmp_path / "r")
    store.save_rollup(built(points, T + 1800, T + 4 * DAY), path)
    clean = audit_store(spark, path, MT, points)
    assert clean.compared == () and clean.cells.count() == 0
    lost = (F.col("time") >= C.moment(T + DAY)) & (F.col("time") < C.moment(T + DAY + 3600)) & (F.col("host") == "h1")
    late = spark.createDataFrame([(EPOCH + timedelta(seconds=T + 3 * DAY + 60), "h9", None, 1.0)], points.schema)
    found = audit_store(spark, path, MT, points.where(~lost).unionByName(late))
    first = (T + DAY) // DAY * DAY
    assert found.compared == ((first, first + DAY), (first + 2 * DAY, first + 3 * DAY))
    cells = found.cells.collect()
    assert {(r.host, r.stored is None, r.fresh is None) for r in cells} == {("h1", False, True), ("h9", True, False)}
    assert sum(r.host == "h9" for r in cells) == 2 and all(r.platform is None for r in cells if r.host == "h9")


# ---- clustering --------------------------------------------------------------------------------


def files_read(df):
    """How many files the scans of a plan read."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo = [plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numFiles").value()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_filter_on_any_one_tag_reads_a_quarter_of_a_clustered_rollup(spark, tmp_path):
    path = str(tmp_path / "r")
    rows_ = [(EPOCH + timedelta(seconds=T + 3600 * h), f"h{a:02}", None if b == 5 else f"p{b}", float(a + b)) for h in range(3) for a in range(24) for b in range(16)]
    wide = spark.createDataFrame(rows_, "time timestamp_ntz, host string, platform string, cpu double")
    store.save_rollup(built(wide), path)
    whole = held(spark, path)
    taken = store.load_rollup(spark, path, MT).df
    cuts = store.cluster(spark, path, rows_per_file=80)
    assert {t: len(c) for t, c in cuts.items()} == {"host": 3, "platform": 3}
    assert held(spark, path) == whole and len(taken.collect()) == len(whole)
    every = files_read(store.load_rollup(spark, path, MT).df)
    assert every >= 16
    for tag, value in (("host", "h07"), ("platform", "p0"), ("platform", "p9"), ("host", "unknown")):
        one = store.load_rollup(spark, path, MT, where={tag: value})
        assert files_read(one.df) <= every / 4 and rows(R.finalize(one, ("mean", "max"))) == [r for r in whole if r[1 + MT.tags.index(tag)] == value]
    assert files_read(store.load_rollup(spark, path, MT, where={"host": "h07", "platform": "p0"}).df) <= every / 16
    # late points lie beside the cells until they are folded in
    late = built(spark.createDataFrame([(EPOCH + timedelta(seconds=T), "h07", "p0", 100.0)], wide.schema))
    store.merge_rollup(late, path, "late")
    assert max(r[-1] for r in rows(R.finalize(store.load_rollup(spark, path, MT, where={"host": "h07"}), ("mean", "max")))) == 100.0
    after = held(spark, path)
    store.cluster(spark, path, rows_per_file=80)
    store.vacuum(spark, path, keep=-60)
    assert held(spark, path) == after
    save = built(wide.where("host = 'h01'"), T, T + 3600)
    store.save_rollup(save, path)
    assert len(held(spark, path)) == len(whole) - 16 * 24 + 16
