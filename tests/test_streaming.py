import pytest

from rollmill.jobs.serve import serve
from rollmill.operators import aggregate as A
from rollmill.operators import rollup as R
from rollmill.sources import store
from rollmill.spec import MetricQuery, MetricTable
from rollmill.streaming import rollups as S

MT = MetricTable("m", "time", ("host",), ("v",), ("id",))
SCHEMA = "id long, time timestamp_ntz, host string, v double"


def _points(spark):
    return spark.sql("SELECT id, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 37) % 5000) AS time, concat('h', id % 3) AS host, double(id % 11) AS v FROM range(900)")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_merge_to_the_batch_rollup(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    points = _points(spark).repartition(3)
    points.where("id % 2 = 0").write.parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    S.stream_upsert(stream(), MT, 600, ("host",), out, check).awaitTermination()
    points.where("id % 2 = 1").write.mode("append").parquet(src)
    S.stream_upsert(stream(), MT, 600, ("host",), out, check).awaitTermination()
    want = _rows(A.bucket_agg(points, MT, 600, ("host",), ("mean", "count")).select("bucket", "host", "mean_v", "count_v"))
    assert _rows(R.finalize(S.read_upserted(spark, out, MT, 600, ("host",)), ("mean", "count"))) == want
    S.compact(spark, out, str(tmp_path / "folded"), MT, 600, ("host",))
    assert _rows(R.finalize(S.read_upserted(spark, str(tmp_path / "folded"), MT, 600, ("host",)), ("mean", "count"))) == want


def test_points_behind_the_watermark_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    t = lambda s: f"timestamp_ntz '2024-01-01 {s}'"
    row = lambda i, s: spark.sql(f"SELECT {i}L AS id, {t(s)} AS time, 'h' AS host, 1.0D AS v")
    found = []
    for i, s in enumerate(("00:05:00", "05:00:00", "00:06:00")):
        row(i, s).coalesce(1).write.mode("append").parquet(src)
        live = S.stream_rollup(spark.readStream.schema(SCHEMA).parquet(src), MT, 600, ("host",), "1 hour", ("count",))
        q = live.writeStream.outputMode("update").foreachBatch(lambda b, n: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sum(r["v__n"] for r in found if r.bucket.hour == 0) == 1


def test_points_beyond_the_horizon_are_left_out(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.sql("SELECT id, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, id, 0, 0) AS time, 'h' AS host, 1.0D AS v FROM range(5)").coalesce(1).write.parquet(src)
    S.stream_upsert(spark.readStream.schema(SCHEMA).parquet(src), MT, 600, ("host",), out, check, horizon=7200).awaitTermination()
    assert sorted(r.bucket.hour for r in S.read_upserted(spark, out, MT, 600, ("host",)).df.collect()) == [2, 3, 4]


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_stream_killed_around_a_commit_counts_every_point_once(spark, tmp_path, monkeypatch, when):
    """The second batch dies before or after its states are committed; the restarted stream replays it, and a dashboard is served what batches give."""
    src, root, check = (str(tmp_path / x) for x in ("src", "root", "check"))
    points = _points(spark)
    points.repartition(4).write.parquet(src)
    path = store.place(root, S.upserted_meta(MT, 600, ("host",)))
    stream = lambda: S.stream_upsert(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), MT, 600, ("host",), path, check)
    real = store.merge_rollup

    def dies(delta, where, source, n):
        if n < 1:
            return real(delta, where, source, n)
        if when == "after":
            assert real(delta, where, source, n)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "merge_rollup", dies)
        with pytest.raises(Exception, match="killed"):
            stream().awaitTermination()
    assert store.snapshot(spark, path).ledger == {"stream": 1 if when == "after" else 0}
    reader = store.load_rollup(spark, path, MT).df
    n_before = reader.count()
    stream().awaitTermination()
    assert store.snapshot(spark, path).ledger == {"stream": 3} and reader.count() == n_before
    got = serve(root, points.limit(0), MT, MetricQuery("m", ("v",), "mean", 1200, ("host",), (), 1704067200, 1704074400))
    assert got.kind == "hit" and _rows(got.df) == _rows(A.bucket_agg(points, MT, 1200, ("host",), ("mean",)))
