"""Filling gaps of bucketed series with explicit null rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_zoned, moment, to_epoch


def _step(seconds: int):
    return F.make_dt_interval(secs=F.lit(seconds))


def _shift(at, seconds):
    return at + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def fill_edges(df: DataFrame, tags, start: int, end: int, window: int) -> DataFrame:
    """Null rows before the first and after the last bucket of each series where the gap to the range exceeds one window.

    Head: ``gap // window + 1`` rows at ``first - i * window``; tail: ``gap // window`` rows at ``last + i * window``. Gaps inside stay.
    """
    span = df.groupBy(*tags).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    zoned = is_zoned(df)
    head, tail = to_epoch(F.col("a"), zoned=zoned) - F.lit(start), F.lit(end) - to_epoch(F.col("b"), zoned=zoned)
    n_head = F.when(head > window, F.floor(head / window) + 1).otherwise(0).cast("int")
    n_tail = F.when(tail > window, F.floor(tail / window)).otherwise(0).cast("int")
    before = F.transform(F.when(n_head > 0, F.sequence(F.lit(1), n_head)).otherwise(F.array().cast("array<int>")), lambda i: _shift(F.col("a"), -i * window))
    after = F.transform(F.when(n_tail > 0, F.sequence(F.lit(1), n_tail)).otherwise(F.array().cast("array<int>")), lambda i: _shift(F.col("b"), i * window))
    added = span.select(*tags, F.explode(F.concat(before, after)).alias("bucket"))
    return df.unionByName(added, allowMissingColumns=True)


def fill_grid(df: DataFrame, tags, start: int, end: int, window: int, count_zero: bool = False, max_rows: int | None = None) -> DataFrame:
    """Every window of [start, end) for every series; what is missing is null (counts 0 with ``count_zero``).

    Made after aggregation, without a grid and without a join: each row also gives the missing windows up to the next one of its series
    (the first those before it too). Buckets outside the range, or not on its windows, only tell that the series exists. More than ``max_rows`` is an error, not a cap.
    """
    low, high = start // window * window, -(-end // window) * window
    if max_rows is not None:
        total = (df.select(*tags).distinct().count() if tags else 1) * ((high - low) // window)
        if total > max_rows:
            raise ValueError(f"the grid has {total} rows, more than {max_rows}")
    measures, zoned = [c for c in df.columns if c not in (*tags, "bucket")], is_zoned(df)
    if not tags:  # one series, also where no row tells of it
        df = df.unionByName(df.sparkSession.range(1).select(F.lit(None).cast(df.schema["bucket"].dataType).alias("bucket")), allowMissingColumns=True)
    at = F.col("__at")
    rows = df.withColumn("__at", to_epoch(F.col("bucket"), zoned=zoned))
    fits = F.coalesce((at >= low) & (at < high) & ((at - low) % window == 0), F.lit(False))
    series = Window.partitionBy(*[F.col(t) for t in tags])
    ordered = series.orderBy(F.desc("__in"), "__at")
    rows = rows.withColumn("__in", fits).withColumn("__n", F.row_number().over(ordered)).withColumn("__next", F.lead(F.when(F.col("__in"), at)).over(ordered))
    # windows from the one after this row (or from the first) up to the next row's, this row's own among them
    begin = F.when(F.col("__n") == 1, F.lit(low)).otherwise(at)
    until = F.greatest(F.coalesce("__next", F.lit(high)), F.when(F.col("__in"), at + window))
    steps = F.floor((until - begin) / window).cast("int")
    keep = F.col("__in") | (F.col("__n") == 1)
    some = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: begin + i.cast("long") * window)
    out = rows.where(keep).withColumn("__to", F.explode(F.when(steps > 0, some).otherwise(F.array().cast("array<long>"))))
    own = F.col("__in") & (F.col("__to") == at)
    value = lambda c: F.coalesce(F.when(own, F.col(c)), F.lit(0)).alias(c) if count_zero and c.startswith("count_") else F.when(own, F.col(c)).alias(c)
    return out.select((F.timestamp_seconds("__to") if zoned else moment(F.col("__to"))).alias("bucket"), *tags, *[value(c) for c in measures])
