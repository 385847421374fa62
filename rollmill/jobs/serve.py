"""Answering from a folder of stored rollups: find those that serve, extend them on disk by what is missing, answer from them; keep them up to date with late points."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.gapfill import fill_grid
from ..operators.refresh import delta_for
from ..operators.rollup import DEFAULT, answer, answer_parts, build_rollup, serves, slice_rollup
from ..sources import store
from ..spec import UNMERGED, MetricQuery, MetricTable, Rollup, RollupMeta, fingerprint
from .suite import run_query


@dataclass(frozen=True)
class Served:
    """An answer and how it came about: ``hit`` (nothing computed), ``cover`` (several rollups, nothing computed), ``extend`` (missing ranges were), ``miss`` (a new rollup was built), ``raw`` (no rollup can serve)."""

    df: DataFrame
    kind: str
    #: Ranges of raw points that were aggregated, and how many buckets (of all series) they made.
    read: tuple[tuple[int, int], ...] = ()
    buckets: int = 0
    #: The rollups that the answer comes from, each with its range.
    parts: tuple[tuple[str, int, int], ...] = ()


def _lacks(meta: RollupMeta, low: int, high: int) -> list[tuple[int, int]]:
    """The ranges that a rollup must grow by to cover [low, high): none, one or two, whole buckets of it, without a gap to what it has."""
    w, out = meta.window, []
    if meta.start is not None and low < meta.start:
        out.append((low // w * w, -(-meta.start // w) * w))
    if meta.end is not None and high > meta.end:
        out.append((meta.end // w * w, -(-high // w) * w))
    return out


def cover(metas: list[RollupMeta], low: int, high: int, window: int) -> list[tuple[int | None, int, int]]:
    """[low, high) in stretches ``(rollup, from, to)`` of whole windows; None stands for a stretch that no rollup has.

    From the left always the rollup that reaches furthest (the coarser one of equals): no choice takes fewer rollups.
    """
    whole = [(low if m.start is None else -(-m.start // window) * window, high if m.end is None else m.end // window * window) for m in metas]
    out, at = [], low
    while at < high:
        here = [i for i, (a, b) in enumerate(whole) if a <= at < b]
        if here:
            best = max(here, key=lambda i: (min(whole[i][1], high), metas[i].window, -i))
            to = min(whole[best][1], high)
        else:
            best, to = None, min([a for a, b in whole if a > at and b > a] + [high])
        out.append((best, at, to))
        at = to
    return out


def _saved(rollup: Rollup, path: str) -> int:
    """Stores the rollup; says how many buckets it had."""
    seen = Observation()
    store.save_rollup(replace(rollup, df=rollup.df.observe(seen, F.count(F.lit(1)).alias("n"))), path)
    return seen.get["n"]


def _grown(path: str, meta: RollupMeta, raw: DataFrame, mt: MetricTable, q: MetricQuery, low: int, high: int) -> tuple[tuple[tuple[int, int], ...], int]:
    """Stores what a rollup lacks of [low, high); the ranges that were read and their buckets."""
    read = tuple(_lacks(meta, low, high))
    return read, sum(_saved(delta_for(Rollup(raw, mt, meta, q.filters), raw, a, b), path) for a, b in read)


def serve(root: str, raw: DataFrame, mt: MetricTable, query: MetricQuery | str | dict, now: int | None = None) -> Served:
    """Answers a query over whole windows of [start, end) from the rollups stored below ``root``.

    Rollups serve that have its tags, the states and fields, and a window that divides its own. If one holds the whole range the coarsest such answers. Else, where
    several together lack less of the range than any one of them, the fewest that cover it do, each for a stretch of whole windows. What is
    lacking is aggregated from raw points and stored in a rollup beside it, touching only the periods of that range. Where none serves, a rollup of the query's
    tags and window is built, with all fields of the table and all mergeable functions but first and last (these if asked), so that other panels find it. Medians, raw points and open
    ranges go to the raw points. ``create_empty`` adds the windows without points. An answer keeps reading the files that it was taken from.
    """
    spark = raw.sparkSession
    q = (query if isinstance(query, MetricQuery) else MetricQuery.from_json(query)).at(now)
    if q.fn in (None, *UNMERGED) or q.start is None or q.end is None:
        return Served(run_query(raw, mt, q), "raw")
    low, high = q.start // q.window * q.window, -(-q.end // q.window) * q.window
    fields = mt.chosen(q.fields)
    filled = lambda df: fill_grid(df, q.tags, low, high, q.window) if q.create_empty else df
    fits = [(path, m) for path, m, _ in store.find_rollups(spark, root, mt.name, fingerprint(q.filters)) if serves(m, q.tags, q.window, q.fn) and set(fields) <= set(m.fields)]
    fits.sort(key=lambda f: (-f[1].window, f[0]))
    if not fits:
        made = build_rollup(raw, mt, q.window, q.tags, q.filters, tuple(dict.fromkeys((*DEFAULT, q.fn))), low, high)
        path = store.place(root, made.meta)
        n = _saved(made, path)
        stored = store.load_rollup(spark, path, mt, q.filters, low, high)
        return Served(filled(answer(stored, q.fn, q.window, q.tags, fields, low, high)), "miss", ((low, high),), n, ((path, low, high),))
    lack = lambda ranges: sum(b - a for a, b in ranges)
    path, meta = min(fits, key=lambda f: lack(_lacks(f[1], low, high)))
    alone = lack(_lacks(meta, low, high))
    stretches = cover([m for _, m in fits], low, high, q.window)
    if alone and len({i for i, _, _ in stretches if i is not None}) > 1 and lack([(a, b) for i, a, b in stretches if i is None]) < alone:
        parts, read, n = [], (), 0
        for k, (i, a, b) in enumerate(stretches):
            if i is None:  # grows the rollup before it, or the one after it
                i = stretches[k - 1][0] if k else stretches[1][0]
                more, buckets = _grown(*fits[i], raw, mt, q, min(a, fits[i][1].start) if k == 0 else fits[i][1].start, b if k else fits[i][1].end)
                read, n = read + more, n + buckets
            parts.append((fits[i][0], a, b))
        rollups = [slice_rollup(store.load_rollup(spark, p, mt, q.filters, a, b), a, b) for p, a, b in parts]
        return Served(filled(answer_parts(rollups, q.fn, q.window, q.tags, fields)), "extend" if read else "cover", read, n, tuple(parts))
    read, n = _grown(path, meta, raw, mt, q, low, high)
    stored = store.load_rollup(spark, path, mt, q.filters, low, high)
    return Served(filled(answer(stored, q.fn, q.window, q.tags, fields, low, high)), "extend" if read else "hit", read, n, ((path, low, high),))


def absorb(root: str, points: DataFrame, mt: MetricTable, batch: str, number: int = 0) -> int:
    """Merges points that came after their range was stored into every rollup of the table below ``root``; tells how many took them.

    Each rollup takes those that fit its filters and lie in its range, and only the periods that they touch are written. A batch that a rollup holds already (by its name and
    number) changes nothing there, so a failed call is repeated as it was. Points outside a stored range are read when it is extended.
    """
    taken = 0
    for path, m, filters in store.find_rollups(points.sparkSession, root, mt.name):
        delta = build_rollup(points, mt, m.window, m.tags, filters, m.fns, m.start, m.end, m.fields)
        taken += store.merge_rollup(delta, path, batch, number)
    return taken
