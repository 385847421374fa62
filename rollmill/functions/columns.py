"""Column functions: ranges, durations, epochs, series and query keys, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import UNITS


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def moment(epoch: Column | int) -> Column:
    """Epoch seconds as a timestamp without zone (UTC), whatever the session's zone."""
    seconds = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def is_zoned(df: DataFrame, time: str = "bucket") -> bool:
    """Whether a column of times has a zone (a timestamp) or none (read as UTC)."""
    return df.schema[time].dataType.typeName() == "timestamp"


def _literal(epoch: int, zoned: bool) -> Column:
    from datetime import datetime, timedelta, timezone

    at = datetime(1970, 1, 1) + timedelta(seconds=epoch)
    return F.lit(at.replace(tzinfo=timezone.utc)) if zoned else F.lit(str(at)).cast("timestamp_ntz")


def in_range(time: str, start: int | None, end: int | None, bounds: str = "half_open", zoned: bool = False) -> Column:
    """Times of [start, end), or (start, end) with ``bounds="open"``; a missing bound is no bound. The bounds are literals, so readers push them down."""
    t, parts = F.col(time), F.lit(True)
    if start is not None:
        parts = (t > _literal(start, zoned)) if bounds == "open" else (t >= _literal(start, zoned))
    if end is not None:
        upper = t < _literal(end, zoned)
        parts = upper if start is None else parts & upper
    return parts


def to_epoch(time: Column, unit: str = "s", zoned: bool = False) -> Column:
    """Epoch seconds or nanoseconds (of microsecond times). Times without zone are read as UTC, whatever the session's zone."""
    if zoned:
        return F.unix_seconds(time) if unit == "s" else F.unix_micros(time) * 1000
    since = (time - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)")
    return F.floor(since).cast("long") if unit == "s" else (since * 1_000_000).cast("long") * 1000


def duration_seconds(text: Column) -> Column:
    """``10m`` -> 600; null where the unit is unknown or the text is no duration."""
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    number = F.regexp_extract(text, r"^(\d+)[a-z]$", 1)
    return F.when(number != "", number.cast("long") * F.element_at(units, F.regexp_extract(text, r"^\d+([a-z])$", 1)))


def series_key(tags) -> Column:
    """``tag=value`` of all tags but internal ones (leading underscore, but for field and measurement), sorted."""
    shown = [t for t in tags if not t.startswith("_") or t in ("_field", "_measurement")]
    return F.array_join(F.array_sort(F.array(*[F.concat_ws("=", F.lit(t), F.col(t)) for t in shown])), ",")


def filter_key(filters: Column) -> Column:
    """Canonical key of ``array<struct<type, key, value, filter: array<struct<type, key, value>>>>``: orders do not matter."""
    leaf = lambda x: F.concat_ws("=", x["key"], x["value"])
    node = lambda f: F.when(F.coalesce(f["type"], F.lit("raw")) == "raw", leaf(f)).otherwise(F.concat(f["type"], F.lit("("), F.array_join(F.array_sort(F.transform(f["filter"], leaf)), ","), F.lit(")")))
    return F.array_join(F.array_sort(F.transform(F.coalesce(filters, F.array().cast(_FILTERS)), node)), "&")


def ordered_filter_key(filters: Column) -> Column:
    """As ``filter_key`` but with filters and leaves as they stand."""
    leaf = lambda x: F.concat_ws("=", x["key"], x["value"])
    node = lambda f: F.when(F.coalesce(f["type"], F.lit("raw")) == "raw", leaf(f)).otherwise(F.concat(f["type"], F.lit("("), F.array_join(F.transform(f["filter"], leaf), ","), F.lit(")")))
    return F.array_join(F.transform(F.coalesce(filters, F.array().cast(_FILTERS)), node), "&")


_FILTERS = "array<struct<type:string,key:string,value:string,filter:array<struct<type:string,key:string,value:string>>>>"


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def missing_range(q_start: Column, q_end: Column, r_start: Column, r_end: Column, window: Column) -> Column:
    """What a rollup over [r_start, r_end] lacks of a query's range, with a tolerance of one window.

    ``struct<kind: hit | start | end | full, start, end>``; start and end are null for a hit. Head and tail are tested
    independently; both, or a range that does not touch the rollup's, make ``full``.
    """
    head, tail = q_start < r_start - window, q_end > r_end + window
    apart = (q_end <= r_start) | (q_start >= r_end)
    kind = F.when(apart | (head & tail), "full").when(head, "start").when(tail, "end").otherwise("hit")
    start = F.when(kind == "end", r_end).when(kind != "hit", q_start)
    end = F.when(kind == "start", r_start).when(kind != "hit", q_end)
    return F.struct(kind.alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"))
