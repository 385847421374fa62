"""Answering queries and suites of queries."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame

from ..operators.aggregate import apply_filters, bucket_agg, in_time, select_raw
from ..operators.gapfill import fill_grid
from ..operators.median import exact_median
from ..operators.rollup import answer, build_rollup
from ..spec import UNMERGED, MetricQuery, MetricTable, fingerprint


def run_query(df: DataFrame, mt: MetricTable, query: MetricQuery | str | dict, now: int | None = None) -> DataFrame:
    """A query from raw points: filter, range, bucket, aggregate, project. One lazy plan with one exchange, but for medians: these run jobs that spread a group over many tasks (``exact_median``)."""
    q = query if isinstance(query, MetricQuery) else MetricQuery.from_json(query)
    q = q.at(now)
    if q.table != mt.name:
        raise ValueError(f"the query is about {q.table}, not {mt.name}")
    part = in_time(apply_filters(df, q.filters), mt, q.start, q.end)
    if q.fn is None:
        return select_raw(part, mt, q.fields, q.tags)
    if q.fn == "median":
        found = exact_median(part, mt, q.window, q.tags, q.fields)
        return fill_grid(found, q.tags, q.start, q.end, q.window) if q.create_empty else found
    return bucket_agg(part, mt, q.window, q.tags, (q.fn,), q.fields, create_empty=q.create_empty, start=q.start, end=q.end)


class Suite(dict):
    """Answers by name. The rollups behind them stay cached until ``release``, or until the end of a ``with`` block."""

    def __init__(self):
        super().__init__()
        self.cached: list[DataFrame] = []

    def release(self) -> None:
        while self.cached:
            self.cached.pop().unpersist()

    def __enter__(self) -> Suite:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def answer_suite(df: DataFrame, mt: MetricTable, queries: dict[str, MetricQuery], now: int | None = None, persist: bool = True) -> Suite:
    """A dashboard's queries with reuse: those with one filter set share one rollup.

    It has the union of their tags and fields, the gcd of their windows and the hull of their ranges, and is
    cached once. Ranges are widened to whole buckets of it. Medians go to the raw points. ``create_empty`` fills the windows of a query's range.
    """
    by: dict[str, list[tuple[str, MetricQuery]]] = {}
    for name, q in queries.items():
        by.setdefault(fingerprint(q.filters), []).append((name, q.at(now)))
    out = Suite()
    for group in by.values():
        merged = [(n, q) for n, q in group if q.fn not in (None, *UNMERGED)]
        for name, q in group:
            if q.fn in (None, *UNMERGED):
                out[name] = run_query(df, mt, q)
        if not merged:
            continue
        qs = [q for _, q in merged]
        window = reduce(gcd, [q.window for q in qs])
        low = None if any(q.start is None for q in qs) else min(q.start for q in qs) // window * window
        high = None if any(q.end is None for q in qs) else -(-max(q.end for q in qs) // window) * window
        tags = tuple(sorted({t for q in qs for t in q.tags}))
        fields = tuple(f for f in mt.fields if any(f in mt.chosen(q.fields) for q in qs))
        rollup = build_rollup(df, mt, window, tags, qs[0].filters, tuple(dict.fromkeys(q.fn for q in qs)), low, high, fields)
        if persist:
            out.cached.append(rollup.df.persist())
        for name, q in merged:
            found = answer(rollup, q.fn, q.window, q.tags, q.fields, q.start, q.end)
            out[name] = fill_grid(found, q.tags, q.start, q.end, q.window) if q.create_empty else found
    return out
