"""A log of dashboard queries against a catalog of rollups: what could have been reused, what must be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import duration_seconds, filter_key, is_subset, missing_range, ordered_filter_key
from ..spec import UNMERGED

DOCUMENT = """bucket string, table string, yield string, doTrace boolean, range struct<start: bigint, end: bigint>,
    relativeRange struct<fr: string, to: string>,
    filters array<struct<type: string, key: string, value: string, filter: array<struct<type: string, key: string, value: string>>>>,
    measurements array<string>, groupKeys array<string>, aggregate struct<timeWindow: string, aggFunc: string, createEmpty: boolean>"""


def parse_query_log(df: DataFrame, col: str = "doc", now: int | None = None) -> DataFrame:
    """Query documents as typed rows beside the log's other columns.

    Defaults: ``createEmpty`` false, filter type ``raw``. A relative range is resolved with ``now``; a missing end is ``now``.
    """
    own = [c for c in df.columns if c != col]
    # through a generator, so that the optimizer does not parse once for every field that is asked for
    rows = df.select(*own, F.explode(F.array(F.from_json(col, DOCUMENT))).alias("d"))
    at = F.lit(now).cast("long")
    start = F.coalesce(F.col("d.range.start"), at - duration_seconds(F.col("d.relativeRange.fr")))
    end = F.coalesce(F.col("d.range.end"), at - F.coalesce(duration_seconds(F.col("d.relativeRange.to")), F.lit(0)))
    return rows.select(
        *own, F.col("d.bucket").alias("bucket"), F.col("d.table").alias("table"), F.col("d.yield").alias("yield"), start.alias("q_start"), end.alias("q_end"), F.col("d.filters").alias("filters"),
        F.col("d.measurements").alias("measurements"), F.array_sort(F.coalesce("d.groupKeys", F.array().cast("array<string>"))).alias("tags"),
        F.col("d.aggregate.aggFunc").alias("agg_fn"), F.col("d.aggregate.timeWindow").alias("window_text"), duration_seconds(F.col("d.aggregate.timeWindow")).alias("window_s"),
        F.coalesce("d.aggregate.createEmpty", F.lit(False)).alias("create_empty"),
    )


def query_fingerprint(log: DataFrame) -> DataFrame:
    """Adds ``fingerprint``: table, function and canonical filters; equal filters in another order give the same."""
    return log.withColumn("fingerprint", F.concat_ws("|", "table", "agg_fn", filter_key(F.col("filters"))))


def exact_query_key(log: DataFrame) -> DataFrame:
    """Adds ``exact_key``: bucket, filters in order, yield, window, function and createEmpty."""
    return log.withColumn("exact_key", F.concat_ws("|", "bucket", ordered_filter_key(F.col("filters")), "yield", "window_text", "agg_fn", F.col("create_empty").cast("string")))


#: What decides which rollups can serve a query at all: everything but its range.
SHAPE = ("fingerprint", "tags", "window_s", "agg_fn")


def reuse_match(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs of queries and rollups that can serve them: equal key, fewer or equal tags, a multiple of the window; a median only in its own shape.

    ``log``: ``fingerprint, tags, window_s, agg_fn, q_start, q_end``; ``catalog``: ``rollup_id, fingerprint, r_tags, r_window, r_start, r_end``.
    Queries repeat a few shapes (``SHAPE``): each different shape is matched once, and the log is joined with the shapes' rollups.
    """
    return log.join(_served(log, catalog), list(SHAPE)).select(*log.columns, F.inline("__rollups"))


def _served(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per shape of the log the rollups that can serve it, as a list (of one fingerprint's rollups at most)."""
    fits = is_subset(F.col("tags"), F.col("r_tags")) & (F.col("window_s") % F.col("r_window") == 0)
    same = (F.array_sort("tags") == F.array_sort("r_tags")) & (F.col("window_s") == F.col("r_window"))
    shapes = log.select(*SHAPE).distinct()
    served = shapes.join(catalog, "fingerprint").where(fits & (~F.col("agg_fn").isin(*UNMERGED) | same))
    return served.groupBy(*SHAPE).agg(F.collect_list(F.struct(*[c for c in catalog.columns if c != "fingerprint"])).alias("__rollups"))


def reuse_cover(log: DataFrame, catalog: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Per query the fewest rollups that together hold what any of them holds of its range, in whole windows: ``rollups, n_rollups, covered_s, missing_s``.

    From the left always the rollup that reaches furthest, then the coarsest, then the smallest id; stretches that none has are missing. A fold over the
    rollups of the query's shape in the order of their starts: the log is neither multiplied nor shuffled by query. Queries that no rollup serves miss their whole range.
    """
    w = F.col("window_s")
    low, high = (F.floor(F.col("q_start") / w) * w).cast("long"), (F.ceil(F.col("q_end") / w) * w).cast("long")
    whole = lambda r: F.struct(
        F.greatest((F.ceil(r["r_start"] / w) * w).cast("long"), F.col("__low")).alias("a"), F.least((F.floor(r["r_end"] / w) * w).cast("long"), F.col("__high")).alias("b"), r["r_window"].cast("long").alias("w"), (-r["rollup_id"]).cast("long").alias("i"),
    )
    rank = lambda x: F.struct(x["b"].alias("b"), x["w"].alias("w"), x["i"].alias("i"))
    none = F.struct(F.col("__low").alias("b"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("i"))
    state = lambda at, best, picks, missing: F.struct(at.alias("at"), best.alias("best"), picks.alias("picks"), missing.alias("missing"))

    def taken(s):
        """The best rollup so far joins the cover if it reaches further."""
        more = s["best"]["b"] > s["at"]
        return F.when(more, s["best"]["b"]).otherwise(s["at"]), F.when(more, F.concat(s["picks"], F.array(-s["best"]["i"]))).otherwise(s["picks"])

    def step(s, x):
        at, picks = taken(s)
        beyond = x["a"] > s["at"]  # none of those still to come starts before
        now = F.when(beyond, F.greatest(at, x["a"])).otherwise(s["at"])
        best = F.when(beyond, rank(x)).otherwise(F.greatest(s["best"], rank(x)))
        return state(now, best, F.when(beyond, picks).otherwise(s["picks"]), s["missing"] + F.when(beyond, F.greatest(x["a"] - at, F.lit(0).cast("long"))).otherwise(0))

    def end(s):
        at, picks = taken(s)
        return F.struct(picks.alias("rollups"), (s["missing"] + F.greatest(F.col("__high") - at, F.lit(0).cast("long"))).alias("missing_s"))

    rows = log.join(_served(log, catalog), list(SHAPE), "left").withColumn("__low", low).withColumn("__high", high)
    parts = F.array_sort(F.filter(F.transform(F.coalesce("__rollups", F.array().cast(_rollups(catalog))), whole), lambda x: x["b"] > x["a"]))
    rows = rows.withColumn("__c", F.aggregate(parts, state(F.col("__low"), none, F.array().cast("array<bigint>"), F.lit(0).cast("long")), step, end))
    missing = F.col("__c.missing_s")
    return rows.select(query_col, F.col("__c.rollups").alias("rollups"), F.size("__c.rollups").cast("long").alias("n_rollups"), (F.col("__high") - F.col("__low") - missing).alias("covered_s"), missing.alias("missing_s"))


def _rollups(catalog: DataFrame) -> str:
    return "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in catalog.schema.fields if f.name != "fingerprint") + ">>"


def reuse_classify(matched: DataFrame) -> DataFrame:
    """Adds ``kind`` (hit, start, end, full) and the range still to compute, widened to whole windows of the rollup, with its seconds."""
    m = missing_range(F.col("q_start"), F.col("q_end"), F.col("r_start"), F.col("r_end"), F.col("r_window"))
    out = matched.withColumn("m", m)
    low = F.floor(F.col("m.start") / F.col("r_window")) * F.col("r_window")
    high = F.ceil(F.col("m.end") / F.col("r_window")) * F.col("r_window")
    out = out.withColumn("kind", F.col("m.kind")).withColumn("missing_start", low.cast("long")).withColumn("missing_end", high.cast("long")).drop("m")
    return out.withColumn("missing_s", F.coalesce(F.col("missing_end") - F.col("missing_start"), F.lit(0)).cast("long"))


def reuse_best(classified: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Per query the rollup that leaves least to compute, with what it leaves; then the coarsest, then the smallest id.

    A maximum of a struct: it combines before the exchange, however many rollups fit one query.
    """
    key = F.struct((-F.col("missing_s")).alias("a"), F.col("r_window").alias("b"), (-F.col("rollup_id")).alias("c"))
    cols = [c for c in ("rollup_id", "kind", "missing_start", "missing_end", "missing_s", "r_window", "r_start", "r_end") if c in classified.columns]
    best = classified.groupBy(query_col).agg(F.max_by(F.struct(*cols), key).alias("r"))
    return best.select(query_col, "r.*")


def reuse_summary(classified: DataFrame, by=("table",)) -> DataFrame:
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("kind") == "hit").alias("hits"), F.count_if(F.col("kind").isin("start", "end")).alias("partial"),
        F.sum("missing_s").alias("missing_s"), F.avg((F.col("kind") == "hit").cast("double")).alias("hit_ratio"),
    )
