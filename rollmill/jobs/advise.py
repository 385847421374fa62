"""Which rollups to build for a log of queries: greedy choice by benefit over the lattice of tag sets and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import build_rollup, rollup_lattice
from ..sources.store import shared_folder
from ..spec import MetricTable


def lattice_sizes(points: DataFrame, mt: MetricTable, windows, tags, filters=()) -> DataFrame:
    """Rows that a rollup would have, for every subset of the tags and every window: ``r_tags`` (sorted), ``r_window, rows``. Exact; per window one pass over the points with grouping sets."""
    tags, parts = sorted(tags), []
    for w in sorted(windows):
        sets = rollup_lattice(build_rollup(points, mt, w, tags, filters, ("count",), fields=mt.fields[:1]), tags)
        # a bit of ``grouping`` is set where a tag is merged away, the first tag highest
        kept = F.filter(F.array(*[F.when(F.col("grouping").bitwiseAND(1 << (len(tags) - 1 - i)) == 0, F.lit(t)) for i, t in enumerate(tags)]), lambda t: t.isNotNull()) if tags else F.array().cast("array<string>")
        parts.append(sets.groupBy("grouping").agg(F.count(F.lit(1)).alias("rows")).select(kept.alias("r_tags"), F.lit(w).cast("long").alias("r_window"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def advise_rollups(log: DataFrame, sizes: DataFrame, raw_rows: int, k: int) -> DataFrame:
    """The ``k`` rollups to build, in the order of their choice: ``pick, r_tags, r_window, rows, benefit``.

    ``log``: ``tags`` (sorted), ``window_s``, one row per query (of one table and filter set, with functions that merge); ``sizes``: as from ``lattice_sizes``. A query costs the rows of the smallest chosen
    rollup that serves it, or ``raw_rows``. Each choice is the rollup that saves most rows over all queries (then the smaller one, then by tags and window); at least
    63 % of what the best k could save is reached. Choices that save nothing are not made. The log is counted by shape once; each round is one job over shapes times rollups that serve them.
    """
    shapes = log.groupBy("tags", "window_s").agg(F.count(F.lit(1)).alias("queries"))
    serves = (F.size(F.array_except("tags", "r_tags")) == 0) & (F.col("window_s") % F.col("r_window") == 0)
    pairs = shapes.join(sizes, serves).select("tags", "window_s", "queries", "r_tags", "r_window", "rows")
    path = shared_folder(log.sparkSession, "advice")
    pairs.write.parquet(path)
    pairs = log.sparkSession.read.schema(pairs.schema).parquet(path)
    picks: list[tuple] = []
    while len(picks) < k:
        chosen = reduce(lambda a, b: a | b, [(F.col("r_window") == p[1]) & (F.array_join("r_tags", "\x00") == "\x00".join(p[0])) for p in picks], F.lit(False))
        cost = pairs.groupBy("tags", "window_s").agg(F.least(F.lit(raw_rows), F.coalesce(F.min(F.when(chosen, F.col("rows"))), F.lit(raw_rows))).alias("cost"))
        saved = F.sum(F.col("queries") * F.greatest(F.col("cost") - F.col("rows"), F.lit(0))).cast("long").alias("benefit")
        best = pairs.join(cost, ["tags", "window_s"]).groupBy("r_tags", "r_window", "rows").agg(saved).orderBy(F.desc("benefit"), "rows", "r_tags", "r_window").first()
        if best is None or not best.benefit:
            break
        picks.append((list(best.r_tags), best.r_window, best["rows"], best.benefit))
    return log.sparkSession.createDataFrame([(i + 1, *p) for i, p in enumerate(picks)], "pick long, r_tags array<string>, r_window long, rows long, benefit long")
