"""Incremental refresh: only the missing range is aggregated."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions.columns import in_range, is_zoned
from ..spec import Rollup
from .aggregate import apply_filters, in_time
from .rollup import build_rollup, merge_rows, union_parts


def delta_for(rollup: Rollup, raw: DataFrame, start: int, end: int) -> Rollup:
    """The rollup's own states (tags, window, functions, filters, all its fields) over [start, end)."""
    m = rollup.meta
    return build_rollup(raw, rollup.mt, m.window, m.tags, rollup.filters, m.fns, start, end, m.fields)


def extend(rollup: Rollup, raw: DataFrame, new_start: int | None = None, new_end: int | None = None) -> Rollup:
    """Grows the range at either end, reading only the delta.

    The bucket in which the old range ends (or starts) may be partial, so it is computed again and replaced.
    """
    m, parts = rollup.meta, []
    start, end = m.start, m.end
    body = rollup.df
    if new_end is not None and new_end > end:
        cut = end // m.window * m.window
        parts.append(delta_for(rollup, raw, cut if start is None else max(cut, start if new_start is None else min(start, new_start)), new_end).df)
        body = body.where(in_range("bucket", None, cut, zoned=is_zoned(body)))
        end = new_end
    if new_start is not None and new_start < start:
        cut = -(-start // m.window) * m.window
        parts.append(delta_for(rollup, raw, new_start, cut).df)
        body = body.where(in_range("bucket", cut, None, zoned=is_zoned(body)))
        start = new_start
    return replace(rollup, df=union_parts(body, *parts), meta=replace(m, start=start, end=end))


def merge_states(rollup: Rollup, delta: DataFrame) -> Rollup:
    """Merges the states of new points (late ones, new series) into the old: union and one exchange."""
    return replace(rollup, df=merge_rows(rollup.df.unionByName(delta), rollup.meta))


def raw_delta(rollup: Rollup, raw: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """The raw points that a delta reads: filters and range reach the scan."""
    return in_time(apply_filters(raw, rollup.filters), rollup.mt, start, end)

