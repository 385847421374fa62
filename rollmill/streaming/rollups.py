"""Rollups of arriving points with Structured Streaming."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import DEFAULT, _state, build_rollup, states_of
from ..sources import store
from ..spec import MetricTable, Rollup, RollupMeta, fingerprint, seconds


def zoned(stream: DataFrame, mt: MetricTable) -> DataFrame:
    """Watermarks need times with a zone; run sessions in UTC."""
    return stream.withColumn(mt.time, F.col(mt.time).cast("timestamp"))


def stream_rollup(stream: DataFrame, mt: MetricTable, window: int | str, tags, watermark: str = "1 hour", fns=DEFAULT) -> DataFrame:
    """A continuous rollup for output modes update or append: state is held for open windows only, points behind the watermark are dropped."""
    window = seconds(window)
    points = zoned(stream, mt).withWatermark(mt.time, watermark)
    out = points.groupBy(F.window(mt.time, f"{window} seconds").alias("w"), *tags).agg(*[_state(s, f, mt) for f in mt.fields for s in states_of(fns)])
    return out.select(F.col("w.start").alias("bucket"), *tags, *[f"{f}__{s}" for f in mt.fields for s in states_of(fns)])


def stream_upsert(
    stream: DataFrame, mt: MetricTable, window: int | str, tags, path: str, checkpoint: str, fns=DEFAULT, horizon: int | None = None, filters=(), name: str = "stream", start: int | None = None, end: int | None = None
) -> StreamingQuery:
    """Merges each micro-batch into the rollup stored in ``path`` (``store.place`` of its ``meta`` below a root makes ``serve`` find it).

    States and the number of the batch are committed in one manifest, so a batch that is replayed after a crash counts once; ``name`` tells streams
    into one rollup apart. Only touched periods get a new write, and periods of many writes are folded together in place; readers keep the files that they began
    with. Takes late points, with ``horizon`` only as long as they lie within that many seconds of the batch's latest. The stored range is [start, end):
    open by default, that is, the stream brings every point there is.
    """

    def write(batch: DataFrame, n: int) -> None:
        if horizon is not None:
            latest = batch.agg(F.max(mt.time)).first()[0]  # one value
            if latest is not None:
                batch = batch.where(F.col(mt.time) >= F.lit(latest - timedelta(seconds=horizon)))
        store.merge_rollup(build_rollup(batch, mt, window, tags, filters, fns, start, end), path, name, n)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted_meta(mt: MetricTable, window: int | str, tags, fns=DEFAULT, filters=(), start: int | None = None, end: int | None = None) -> RollupMeta:
    """What ``stream_upsert`` stores, for ``store.place``."""
    return RollupMeta(mt.name, seconds(window), tuple(tags), tuple(fns), mt.fields, fingerprint(filters), start, end)


def read_upserted(spark: SparkSession, path: str, mt: MetricTable, window: int | str = 0, tags=(), fns=DEFAULT) -> Rollup:
    """What streams have stored in ``path`` so far; window, tags and functions are those of the store."""
    return store.load_rollup(spark, path, mt)


def compact(spark: SparkSession, path: str, target: str, mt: MetricTable, window: int | str = 0, tags=(), fns=DEFAULT) -> None:
    """A copy with one write a period; ``store.compact`` does the same in place."""
    store.save_rollup(read_upserted(spark, path, mt), target)
