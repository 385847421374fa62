"""Rollups: buckets with mergeable states, from which coarser questions are answered exactly.

Per field and as far as asked: ``n``, ``sum``, ``min``, ``max`` and the first and last point. A mean is sum over n, so an
answer from a rollup equals the answer from raw points for whole buckets. A median does not merge.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_range, is_zoned
from ..spec import UNMERGED, MetricTable, Rollup, RollupMeta, fingerprint, seconds
from .aggregate import apply_filters, bucket_agg, edge, in_time, quotient, total

NEEDS = {"mean": ("n", "sum"), "sum": ("sum",), "count": ("n",), "min": ("min",), "max": ("max",), "first": ("first",), "last": ("last",)}
MERGE = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "first": F.min, "last": F.max}
DEFAULT = ("mean", "sum", "count", "min", "max")


def states_of(fns) -> list[str]:
    if bad := [f for f in fns if f not in NEEDS]:
        raise ValueError(f"no mergeable state for {', '.join(bad)}; known: {', '.join(NEEDS)}")
    return list(dict.fromkeys(s for fn in fns for s in NEEDS[fn]))


def _state(kind: str, name: str, mt: MetricTable) -> Column:
    value = F.col(name)
    return {"n": F.count(value), "sum": total(value, mt), "min": F.min(value), "max": F.max(value), "first": F.min(edge(value, mt)), "last": F.max(edge(value, mt))}[kind].alias(f"{name}__{kind}")


def _merged(rollup: Rollup, bucket: Column, tags) -> DataFrame:
    states = [f"{f}__{s}" for f in rollup.meta.fields for s in states_of(rollup.meta.fns)]
    return rollup.df.groupBy(bucket.alias("bucket"), *tags).agg(*[MERGE[c.rpartition("__")[2]](c).alias(c) for c in states])


def merge_rows(df: DataFrame, meta: RollupMeta) -> DataFrame:
    """States of the same buckets and series put together: one exchange."""
    states = [f"{f}__{s}" for f in meta.fields for s in states_of(meta.fns)]
    return df.groupBy("bucket", *meta.tags).agg(*[MERGE[c.rpartition("__")[2]](c).alias(c) for c in states])


def _coarse(window: int) -> Column:
    return F.window("bucket", f"{window} seconds")["start"]


def build_rollup(df: DataFrame, mt: MetricTable, window: int | str, tags, filters=(), fns=DEFAULT, start: int | None = None, end: int | None = None, fields=("*",)) -> Rollup:
    """States of the fields (all by default) per window and tags; one exchange."""
    window, chosen = seconds(window), tuple(mt.chosen(fields))
    df = in_time(apply_filters(df, filters), mt, start, end)
    out = df.groupBy(F.window(mt.time, f"{window} seconds").alias("w"), *tags).agg(*[_state(s, f, mt) for f in chosen for s in states_of(fns)])
    out = out.select(F.col("w.start").alias("bucket"), *tags, *[f"{f}__{s}" for f in chosen for s in states_of(fns)])
    return Rollup(out, mt, RollupMeta(mt.name, window, tuple(tags), tuple(fns), chosen, fingerprint(filters), start, end), tuple(filters))


def slice_rollup(rollup: Rollup, start: int | None, end: int | None) -> Rollup:
    """The whole buckets that overlap [start, end): a predicate on the bucket."""
    df, zoned = rollup.df, is_zoned(rollup.df)
    if start is not None:
        df = df.where(in_range("bucket", start - rollup.meta.window, None, "open", zoned))
    if end is not None:
        df = df.where(in_range("bucket", None, end, zoned=zoned))
    return replace(rollup, df=df, meta=replace(rollup.meta, start=start, end=end))


def regroup(rollup: Rollup, tags) -> Rollup:
    """Drops tags by merging the series that share the remaining ones."""
    _subset(rollup, tags)
    return replace(rollup, df=_merged(rollup, F.col("bucket"), tags), meta=replace(rollup.meta, tags=tuple(tags)))


def downsample(rollup: Rollup, window: int | str) -> Rollup:
    """Coarser buckets; the window must be a multiple."""
    window = _multiple(rollup, window)
    return replace(rollup, df=_merged(rollup, _coarse(window), rollup.meta.tags), meta=replace(rollup.meta, window=window))


def regroup_downsample(rollup: Rollup, tags, window: int | str) -> Rollup:
    """Both in one exchange."""
    _subset(rollup, tags)
    window = _multiple(rollup, window)
    return replace(rollup, df=_merged(rollup, _coarse(window), tags), meta=replace(rollup.meta, tags=tuple(tags), window=window))


def _subset(rollup: Rollup, tags) -> None:
    if not set(tags) <= set(rollup.meta.tags):
        raise ValueError(f"the rollup has tags {rollup.meta.tags}, not {tuple(tags)}")


def _multiple(rollup: Rollup, window: int | str) -> int:
    window = seconds(window)
    if window % rollup.meta.window:
        raise ValueError(f"{window} s is no multiple of the rollup's {rollup.meta.window} s")
    return window


def finalize(rollup: Rollup, fns, fields=("*",)) -> DataFrame:
    """``<fn>_<field>`` columns from states."""
    fields = rollup.meta.fields if list(fields) == ["*"] else fields
    states_of(fns)
    made = {
        "mean": lambda f: quotient(F.col(f"{f}__sum"), F.col(f"{f}__n")), "sum": lambda f: F.col(f"{f}__sum").cast("double"), "count": lambda f: F.col(f"{f}__n"),
        "min": lambda f: F.col(f"{f}__min"), "max": lambda f: F.col(f"{f}__max"), "first": lambda f: F.col(f"{f}__first")["v"], "last": lambda f: F.col(f"{f}__last")["v"],
    }
    return rollup.df.select("bucket", *rollup.meta.tags, *[made[fn](f).alias(f"{fn}_{f}") for fn in fns for f in fields])


def union_parts(*parts: DataFrame) -> DataFrame:
    """Parts of one rollup as one frame, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def serves(meta: RollupMeta, tags, window: int, fn: str) -> bool:
    """Whether a rollup can answer: fewer or equal tags, a multiple of its window; a median only in its own shape."""
    if fn in UNMERGED:
        return fn in meta.fns and set(tags) == set(meta.tags) and window == meta.window
    return set(tags) <= set(meta.tags) and window % meta.window == 0 and set(NEEDS[fn]) <= set(states_of([f for f in meta.fns if f not in UNMERGED]))


def answer(rollup: Rollup, fn: str, window: int | str, tags, fields=("*",), start: int | None = None, end: int | None = None, combine: str = "states", raw: DataFrame | None = None) -> DataFrame:
    """A coarser question from a rollup: slice, then one exchange for tags and window, then the asked measures.

    ``combine="values"`` is the unweighted mean of bucket means (over series, then over buckets).
    A median, or anything the rollup does not serve, is computed from ``raw`` if it is given.
    """
    window = seconds(window)
    if not serves(rollup.meta, tags, window, fn):
        if raw is None:
            raise ValueError(f"the rollup does not serve {fn} by {tuple(tags)} in {window} s")
        w = rollup.meta.window
        low = None if start is None else start // w * w
        high = None if end is None else -(-end // w) * w
        return bucket_agg(in_time(apply_filters(raw, rollup.filters), rollup.mt, low, high), rollup.mt, window, tags, (fn,), fields)
    part = slice_rollup(rollup, start, end)
    if combine == "values":
        return _mean_of_means(part, window, tags, fields)
    if set(tags) == set(rollup.meta.tags) and window == rollup.meta.window:
        return finalize(part, (fn,), fields)  # nothing to merge: no exchange at all
    return finalize(regroup_downsample(part, tags, window), (fn,), fields)


def answer_parts(parts, fn: str, window: int, tags, fields) -> DataFrame:
    """One answer from several rollups, each sliced to its own whole windows of the range: only the states that the function needs are united, then one exchange."""
    mt, states = parts[0].mt, [f"{f}__{s}" for f in fields for s in NEEDS[fn]]
    rows = union_parts(*[p.df.select(_coarse(window).alias("bucket"), *tags, *states) for p in parts])
    meta = replace(parts[0].meta, window=window, tags=tuple(tags), fns=(fn,), fields=tuple(fields))
    return finalize(Rollup(merge_rows(rows, meta), mt, meta), (fn,), fields)


def _mean_of_means(rollup: Rollup, window: int, tags, fields) -> DataFrame:
    fields = rollup.meta.fields if list(fields) == ["*"] else fields
    means = finalize(rollup, ("mean",), fields)
    names = [f"mean_{f}" for f in fields]
    across = means.groupBy("bucket", *tags).agg(*[F.avg(n).alias(n) for n in names])
    return across.groupBy(_coarse(window).alias("bucket"), *tags).agg(*[F.avg(n).alias(n) for n in names])


def rollup_lattice(rollup: Rollup, tags) -> DataFrame:
    """States for every subset of the tags in one pass (grouping sets); ``grouping`` tells which tags are merged away."""
    states = [f"{f}__{s}" for f in rollup.meta.fields for s in states_of(rollup.meta.fns)]
    sets = [["bucket", *[t for k, t in enumerate(tags) if m >> k & 1]] for m in range(1 << len(tags))]
    out = rollup.df.groupingSets([[F.col(c) for c in s] for s in sets], "bucket", *tags)
    return out.agg(F.grouping_id().cast("long").alias("grouping"), *[MERGE[c.rpartition("__")[2]](c).alias(c) for c in states])
