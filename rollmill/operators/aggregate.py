"""Filtering, projecting and bucketing raw points."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_range, is_zoned
from ..spec import FUNCTIONS, MetricTable, seconds


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """All filters; each tree keeps its own brackets."""
    for f in filters:
        df = df.where(f.column())
    return df


def in_time(df: DataFrame, mt: MetricTable, start: int | None, end: int | None, bounds: str = "half_open") -> DataFrame:
    if start is None and end is None:
        return df
    return df.where(in_range(mt.time, start, end, bounds, zoned=is_zoned(df, mt.time)))


def edge(value: Column, mt: MetricTable) -> Column:
    """A point for first and last: time, ties, then the value itself, so that the order is total. Null values do not count."""
    return F.when(value.isNotNull(), F.struct(F.col(mt.time).alias("t"), *[F.col(c).alias(f"tie_{c}") for c in mt.ties], value.alias("v")))


def total(value: Column, mt: MetricTable) -> Column:
    """The sum of a field: a decimal that no order of adding changes if the table declares its places, else a double."""
    if mt.places is None:
        return F.sum(value)
    return (F.sum(units(value, mt)) * F.lit(Decimal(1).scaleb(-mt.places))).cast(f"decimal(38,{mt.places})")


def units(value: Column, mt: MetricTable) -> Column:
    """A field as a whole number of its last declared place. A value that is none (more places, too large, NaN or infinite) is an error, so that no sum is silently off.

    A number of at most 2^53 such units is right if dividing it gives the value back; larger values go through decimals.
    """
    value, scale = value.cast("double"), float(10**mt.places)
    near = F.rint(value * scale)
    as_decimal = value.try_cast(f"decimal(18,{mt.places})")
    refused = F.raise_error(F.concat(F.lit(f"{mt.name} declares {mt.places} places, but has the value "), value.cast("string"))).cast("decimal(18,0)")
    large = F.when(value.isNull(), F.lit(None).cast("decimal(18,0)")).when(as_decimal.cast("double") == value, (as_decimal * F.lit(Decimal(10**mt.places))).cast("decimal(18,0)")).otherwise(refused)
    return F.when((F.abs(value) <= 2.0**53 / scale) & (near / scale == value), near.cast("long").cast("decimal(18,0)")).otherwise(large)


def quotient(total: Column, n: Column) -> Column:
    return total.cast("double") / F.when(n > 0, n)


def aggregate_column(fn: str, name: str, mt: MetricTable) -> Column:
    value = F.col(name)
    made = {
        "mean": lambda: F.avg(value) if mt.places is None else quotient(total(value, mt), F.count(value)), "sum": lambda: total(value, mt).cast("double"), "min": lambda: F.min(value), "max": lambda: F.max(value),
        "count": lambda: F.count(value), "median": lambda: F.median(value), "approx_median": lambda: F.percentile_approx(value, 0.5, 10_000),
        "first": lambda: F.min(edge(value, mt))["v"], "last": lambda: F.max(edge(value, mt))["v"],
    }
    if fn not in made:
        raise ValueError(f"not an aggregate: {fn!r}; known: {', '.join(FUNCTIONS)}")
    return made[fn]().alias(f"{fn}_{name}")


def bucket_agg(df: DataFrame, mt: MetricTable, window: int | str, tags=(), fns=("mean",), fields=("*",), label: str = "start", create_empty: bool = False, start: int | None = None, end: int | None = None) -> DataFrame:
    """``bucket``, tags and ``<fn>_<field>`` per time window (aligned to the epoch) and tags: one exchange, after partial aggregation.

    ``create_empty`` adds the windows of [start, end) in which a series has no points, with nulls.
    """
    window, fields = seconds(window), mt.chosen(fields)
    out = df.groupBy(F.window(mt.time, f"{window} seconds").alias("w"), *tags).agg(*[aggregate_column(fn, f, mt) for fn in fns for f in fields])
    out = out.select(F.col("w.start").alias("bucket"), *tags, *[f"{fn}_{f}" for fn in fns for f in fields])
    if create_empty:
        from .gapfill import fill_grid

        out = fill_grid(out, tags, start, end, window)
    if label == "end":
        out = out.withColumn("bucket", F.col("bucket") + F.make_dt_interval(secs=F.lit(window)))
    return out


def aggregate(df: DataFrame, mt: MetricTable, fields, fn: str, window: int | str, tags=()) -> DataFrame:
    """One function over the chosen fields (``["*"]``: all)."""
    return bucket_agg(df, mt, window, tags, (fn,), fields)


def select_raw(df: DataFrame, mt: MetricTable, fields, tags=()) -> DataFrame:
    """Points as they are."""
    return df.select(mt.time, *tags, *mt.chosen(fields))


def retain_fields(df: DataFrame, tags, measures) -> DataFrame:
    """Bucket, tags and the asked measures; whatever else the frame holds goes."""
    return df.select("bucket", *tags, *measures)


def canonical_order(df: DataFrame, table: str, tags, measures) -> DataFrame:
    """Columns in the order time, table, tags by name, measures."""
    return df.select("bucket", F.lit(table).alias("table"), *sorted(tags), *measures)


def group_series(df: DataFrame, tags) -> DataFrame:
    """Per series (tags by name): buckets, first and last bucket. A series is a key, not an object."""
    return df.groupBy(*sorted(tags)).agg(F.count(F.lit(1)).alias("buckets"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))


def order_result(df: DataFrame, tags) -> DataFrame:
    """Series by their tags, time ascending in each: for the sink only."""
    return df.orderBy(*sorted(tags), "bucket")
