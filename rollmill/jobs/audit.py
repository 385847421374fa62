"""Audits of rollups and summaries of traces."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_zoned
from ..operators.rollup import build_rollup, finalize, slice_rollup
from ..sources import store
from ..spec import MetricTable


def audit_rollup(left: DataFrame, right: DataFrame, tags, measures, tol: float = 1e-9) -> DataFrame:
    """Compares an answer from a rollup with one from raw points, cell by cell: one row of counts and of the largest errors.

    A null-safe full join on bucket and tags; a cell differs if only one side is null or the difference exceeds ``tol`` times the larger of 1 and the value.
    """
    keys = ["bucket", *tags]
    a = left.select(F.struct(*keys).alias("k"), *[F.col(m).alias(f"l_{m}") for m in measures], F.lit(True).alias("in_left"))
    b = right.select(F.struct(*keys).alias("k"), *[F.col(m).alias(f"r_{m}") for m in measures], F.lit(True).alias("in_right"))
    both = a.alias("a").join(b.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")), "full")
    here = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    gap = lambda m: F.abs(F.col(f"l_{m}") - F.col(f"r_{m}"))
    off = lambda m: here & ((F.col(f"l_{m}").isNull() != F.col(f"r_{m}").isNull()) | F.coalesce(gap(m) > tol * F.greatest(F.lit(1.0), F.abs(F.col(f"r_{m}"))), F.lit(False)))
    worst = lambda cols: F.greatest(*cols) if len(cols) > 1 else cols[0]
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("in_left").isNull()).alias("missing"), F.count_if(F.col("in_right").isNull()).alias("extra"),
        F.sum(reduce(lambda x, y: x + y, [off(m).cast("long") for m in measures])).alias("differing"),
        F.max(worst([gap(m) for m in measures])).alias("max_abs"), F.max(worst([gap(m) / F.abs(F.when(F.col(f"r_{m}") != 0, F.col(f"r_{m}"))) for m in measures])).alias("max_rel"),
    )


@dataclass(frozen=True)
class StoreAudit:
    """Cells in which a stored rollup differs from raw points, and the ranges whose rows had to be compared."""

    cells: DataFrame
    compared: tuple[tuple[int, int], ...]


def _digests(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Per key the number of rows and the sum of their hashes: equal for equal rows in any order, combined before the exchange."""
    row = F.xxhash64("bucket", *[c for c in df.columns if c not in ("bucket", "period", *measures)], *measures)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h"))


def _unequal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    b = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("n").alias("m"), F.col("h").alias("g"))
    both = left.join(b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "full")
    return both.where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("h").eqNullSafe(F.col("g")))).select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys])


def audit_store(spark: SparkSession, path: str, mt: MetricTable, raw: DataFrame, tol: float = 1e-9) -> StoreAudit:
    """Compares a stored rollup with raw points from the top down: digests of periods, of their first tag's values, then cells.

    Only periods whose digests differ are read again, on both sides (the range reaches the scan of raw points), and only the first tag's values that differ
    there are joined. ``cells``: bucket, tags, ``measure, stored, fresh`` where one side lacks the cell or the values differ by more than ``tol`` times the larger of 1 and the fresh one.
    """
    whole = store.load_rollup(spark, path, mt)
    m = whole.meta
    tags, names = list(m.tags), [f"{fn}_{f}" for fn in m.fns for f in m.fields]
    dated = lambda df: df.withColumn("period", store.period(m.window, is_zoned(df)))

    def sides(start, end):
        stored = slice_rollup(store.load_rollup(spark, path, mt, start=start, end=end), start, end)
        fresh = build_rollup(raw, mt, m.window, m.tags, whole.filters, m.fns, start, end, m.fields)
        return [dated(finalize(r, m.fns)) for r in (stored, fresh)]

    # one row per day or year
    off = sorted(r.period for r in _unequal(*[_digests(df, ["period"], names) for df in sides(m.start, m.end)], ["period"]).collect())
    ranges: list[tuple[int, int]] = []
    for p in off:
        first = datetime.fromisoformat(p if len(p) > 4 else f"{p}-01-01")
        after = datetime(first.year + 1, 1, 1) if len(p) == 4 else None
        a = int((first - datetime(1970, 1, 1)).total_seconds())
        b = a + 86400 if after is None else int((after - datetime(1970, 1, 1)).total_seconds())
        # windows are whole: one that goes on past the period belongs to it by its start
        a, b = -(-a // m.window) * m.window, -(-b // m.window) * m.window
        a, b = a if m.start is None else max(a, m.start), b if m.end is None else min(b, m.end)
        if ranges and ranges[-1][1] == a:
            ranges[-1] = (ranges[-1][0], b)
        else:
            ranges.append((a, b))
    cells = None
    for a, b in ranges:
        found = _cells(*sides(a, b), tags, names, tol)
        cells = found if cells is None else cells.unionByName(found)
    if cells is None:
        cells = _cells(*[df.limit(0) for df in sides(m.start, m.end)], tags, names, tol)
    return StoreAudit(cells, tuple(ranges))


def _cells(stored: DataFrame, fresh: DataFrame, tags: list[str], names: list[str], tol: float) -> DataFrame:
    if tags:
        keys = ["period", tags[0]]
        some = _unequal(*[_digests(df, keys, names) for df in (stored, fresh)], keys).select(*[F.col(k).alias(f"__{k}") for k in keys])
        stored, fresh = (df.join(some, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi") for df in (stored, fresh))
    keys = ["bucket", *tags]
    a = stored.select(F.struct(*keys).alias("k"), F.struct(*names).alias("stored"))
    b = fresh.select(F.struct(*keys).alias("l"), F.struct(*names).alias("fresh"))
    both = a.join(b, F.col("k").eqNullSafe(F.col("l")), "full").select(F.coalesce("k", "l").alias("k"), "stored", "fresh")
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"stored.{n}").cast("double").alias("stored"), F.col(f"fresh.{n}").cast("double").alias("fresh")) for n in names]))
    near = F.abs(F.col("stored") - F.col("fresh")) <= tol * F.greatest(F.lit(1.0), F.abs("fresh"))
    return both.select("k.*", one.alias("c")).select(*keys, "c.*").where(~(F.col("stored").eqNullSafe(F.col("fresh")) | F.coalesce(near, F.lit(False))))


def trace_collate(df: DataFrame, col: str = "traces") -> DataFrame:
    """Per position in a list of ``map<op, seconds>`` and op: mean, median and count over the rows that have the op."""
    rows = df.select(F.posexplode(col).alias("position", "ops")).select("position", F.explode("ops").alias("op", "s"))
    return rows.groupBy("position", "op").agg(F.avg("s").alias("mean_s"), F.median("s").alias("median_s"), F.count("s").alias("n"))


def latency_compare(runs: DataFrame, fn: str = "median") -> DataFrame:
    """Raw and cached seconds per query (``query, mode, s``), and what share of the raw time is saved."""
    agg = {"median": F.median, "mean": F.avg}[fn]
    per = runs.groupBy("query").agg(agg(F.when(F.col("mode") == "raw", F.col("s"))).alias("raw_s"), agg(F.when(F.col("mode") == "cached", F.col("s"))).alias("cached_s"))
    return per.withColumn("saved", 1 - F.col("cached_s") / F.col("raw_s"))
