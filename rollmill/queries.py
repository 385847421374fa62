"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .jobs import advise, audit, reuse
from .jobs.serve import absorb, serve
from .jobs.suite import answer_suite, run_query
from .operators import aggregate as A
from .operators import gapfill, refresh, series
from .operators import rollup as R
from .operators.median import exact_median
from .sources import metrics, store
from .spec import And, Eq, MetricQuery, MetricTable, Or, resolve_relative
from .streaming import rollups as S

EVENTS = MetricTable("events", "ts", ("event_type", "user_id"), ("value", "k"), ("event_id",), places=2)
LINEITEM = MetricTable("lineitem", "l_shipdate", ("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice", "l_discount"), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), places=2)
ORDERS = MetricTable("orders", "o_orderdate", ("o_orderstatus", "o_orderpriority"), ("o_totalprice",), ("o_orderkey",), places=2)

HOUR, DAY, WEEK = 3600, 86400, 604800
#: 2024-01-05, 2024-01-12 and 2024-01-20, in epoch seconds.
T0, T1, T2 = 1704412800, 1705017600, 1705708800
#: Bounds of four-week windows: in 1996, 1998 and 1999.
L0, L1, L2 = 352 * 28 * DAY, 371 * 28 * DAY, 391 * 28 * DAY
NOW = 1706659200  # 2024-01-31


def events(spark: SparkSession, d: str) -> DataFrame:
    return metrics.read_metrics(spark, f"{d}/events.parquet", EVENTS, derive={"k": F.get_json_object("props", "$.k").cast("double")})


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return metrics.read_metrics(spark, f"{d}/lineitem.parquet", LINEITEM)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return metrics.read_metrics(spark, f"{d}/orders.parquet", ORDERS)


def rounded(df: DataFrame) -> DataFrame:
    """Medians and means of means, of which engines differ in the last digit, to six places; sums and means of decimals are exact as they are."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and not c.startswith(("mean_", "sum_")) else F.col(c) for c, t in df.dtypes])


EV = "ev AS (SELECT event_id, ts, event_type, CAST(user_id AS VARCHAR) AS user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"
SQL_FN = {"mean": "CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE) / nullif(count({0}), 0)", "sum": "CAST(sum(CAST({} AS DECIMAL(18, 2))) AS DOUBLE)", "min": "min({})", "max": "max({})", "count": "count({})", "median": "median({})", "approx_median": "quantile_disc({}, 0.5)"}


def _bucket(window: int, col: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{window} seconds', {col}, TIMESTAMP '1970-01-01')"


def _at(epoch: int) -> str:
    return f"(TIMESTAMP '1970-01-01' + INTERVAL '{epoch} seconds')"


def _measure(fn: str, field: str, mt: MetricTable) -> str:
    if fn in ("first", "last"):
        way = " DESC" if fn == "last" else ""
        order = ", ".join(f"{c}{way}" for c in (mt.time, *mt.ties, field))
        body = f"first({field} ORDER BY {order}) FILTER (WHERE {field} IS NOT NULL)"
    else:
        body = SQL_FN[fn].format(field)
    return f"round({body}, 6) AS {fn}_{field}" if "median" in fn else f"{body} AS {fn}_{field}"


def agg_sql(mt: MetricTable, window: int, tags, fns, fields, where: str = "TRUE", extra: str = "") -> str:
    """A direct aggregate from raw points."""
    source, ctes = ("ev", f"WITH {EV} ") if mt is EVENTS else (mt.name, "")
    keys = "".join(f", {t}" for t in tags)
    cols = ", ".join(_measure(fn, f, mt) for fn in fns for f in fields)
    groups = ", ".join(str(i + 1) for i in range(1 + len(tags)))
    return f"{ctes}SELECT {_bucket(window, mt.time)}{extra} AS bucket{keys}, {cols} FROM {source} WHERE {where} GROUP BY {groups}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return register


BOTH = Or(Eq("event_type", "click"), Eq("event_type", "view"))
IN = "event_type IN ('click', 'view')"
RANGE = f"ts >= {_at(T0)} AND ts < {_at(T2)}"

# ---- sources and sinks ---------------------------------------------------------------------


@query("read_metrics", f"WITH {EV} SELECT ts, event_type, user_id, value, k, event_id FROM ev")
def read_metrics(spark, d):
    return events(spark, d)


_FLAT = f"WITH {EV} SELECT ts AS time, value, 'value' AS field, event_type || '/' || user_id AS series, CAST(0 AS INTEGER) AS table_no FROM ev"


@query("flatten_series_docs", _FLAT)
def flatten_series_docs(spark, d):
    """Points nested to one document per user and hour, and flat again."""
    e = events(spark, d)
    record = F.struct(F.col("ts").alias("time"), "value", F.lit("value").alias("field"), F.concat_ws("/", "event_type", "user_id").alias("series"))
    docs = e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.collect_list(record).alias("records"))
    doc = F.to_json(F.array(F.struct(F.array(F.lit("time"), F.lit("value")).alias("columns"), "records")), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return metrics.flatten_series_docs(docs.select(doc.alias("doc"))).select("time", "value", "field", "series", "table_no")


@query("write_json_records", agg_sql(EVENTS, DAY, ("event_type",), ("count", "min"), ("value",)))
def write_json_records(spark, d):
    out = A.bucket_agg(events(spark, d), EVENTS, DAY, ("event_type",), ("count", "min"), ("value",))
    path = store.shared_folder(spark, "records")
    metrics.write_json_records(out, path)
    return spark.read.schema(out.schema).json(path)


@query("append_points", agg_sql(EVENTS, DAY, ("event_type",), ("count", "sum"), ("value",)))
def append_points(spark, d):
    """Points written in two turns and read back."""
    e, path = events(spark, d), store.shared_folder(spark, "points")
    for part in (A.in_time(e, EVENTS, None, T1), A.in_time(e, EVENTS, T1, None)):
        metrics.append_points(part, path)
    return rounded(A.bucket_agg(metrics.read_metrics(spark, path, EVENTS), EVENTS, DAY, ("event_type",), ("count", "sum"), ("value",)))


def _saved(spark, d):
    path = store.shared_folder(spark, "rollup")
    store.save_rollup(R.build_rollup(events(spark, d), EVENTS, HOUR, EVENTS.tags), path)
    return path


@query("save_rollup", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean", "count"), ("value", "k")))
def save_rollup(spark, d):
    """A stored rollup whose second half is then replaced by dates."""
    path = _saved(spark, d)
    half = R.build_rollup(events(spark, d), EVENTS, HOUR, EVENTS.tags, start=T1)
    store.save_rollup(half, path)
    return rounded(R.finalize(store.load_rollup(spark, path, EVENTS), ("mean", "count")))


@query("load_rollup", agg_sql(EVENTS, DAY, ("event_type",), ("mean", "max"), ("value",), RANGE))
def load_rollup(spark, d):
    stored = store.load_rollup(spark, _saved(spark, d), EVENTS)
    by = R.finalize(R.regroup_downsample(R.slice_rollup(stored, T0, T2), ("event_type",), DAY), ("mean", "max"), ("value",))
    return rounded(by)


# ---- projections -------------------------------------------------------------------------------


@query("select_fields", agg_sql(LINEITEM, WEEK, LINEITEM.tags, ("mean",), ("l_quantity", "l_discount")))
def select_fields(spark, d):
    return rounded(A.aggregate(lineitem(spark, d), LINEITEM, ("l_quantity", "l_discount"), "mean", WEEK, LINEITEM.tags))


@query("select_all_fields", agg_sql(LINEITEM, WEEK, LINEITEM.tags, ("max",), LINEITEM.fields))
def select_all_fields(spark, d):
    return rounded(A.aggregate(lineitem(spark, d), LINEITEM, ["*"], "max", WEEK, LINEITEM.tags))


@query("select_raw", f"WITH {EV} SELECT ts, event_type, value, k FROM ev WHERE {IN} AND {RANGE}")
def select_raw(spark, d):
    part = A.in_time(A.apply_filters(events(spark, d), [BOTH]), EVENTS, T0, T2)
    return A.select_raw(part, EVENTS, ("value", "k"), ("event_type",))


@query("retain_fields", agg_sql(EVENTS, DAY, ("event_type",), ("sum",), ("k",)))
def retain_fields(spark, d):
    out = A.bucket_agg(events(spark, d), EVENTS, DAY, ("event_type",), ("sum", "count"), ["*"])
    return rounded(A.retain_fields(out, ("event_type",), ("sum_k",)))


@query("canonical_order", f"SELECT bucket, 'orders' AS \"table\", o_orderpriority, o_orderstatus, mean_o_totalprice FROM ({agg_sql(ORDERS, 28 * DAY, ORDERS.tags, ('mean',), ('o_totalprice',))})")
def canonical_order(spark, d):
    out = A.aggregate(orders(spark, d), ORDERS, ["*"], "mean", 28 * DAY, ORDERS.tags)
    return rounded(A.canonical_order(out, "orders", ORDERS.tags, ["mean_o_totalprice"]))


# ---- filters ---------------------------------------------------------------------------------------


def _filtered(name: str, where: str, *nodes):
    @query(name, agg_sql(EVENTS, DAY, ("event_type",), ("count", "sum"), ("value",), where))
    def run(spark, d):
        part = A.apply_filters(events(spark, d), nodes)
        return rounded(A.bucket_agg(part, EVENTS, DAY, ("event_type",), ("count", "sum"), ("value",)))


_filtered("filter_tag_eq", "event_type = 'click'", Eq("event_type", "click"))
_filtered("filter_or", IN, BOTH)
_filtered("filter_and", "event_type = 'click' AND user_id = '7'", And(Eq("event_type", "click"), Eq("user_id", 7)))
_filtered(
    "filter_list", "(event_type = 'click' OR (event_type = 'view' AND user_id = '7')) AND user_id IN ('7', '8', '46')",
    Or(Eq("event_type", "click"), And(Eq("event_type", "view"), Eq("user_id", "7"))), Or(Eq("user_id", "7"), Eq("user_id", "8"), Eq("user_id", "46")),
)


def _ranged(name: str, where: str, start, end, bounds="half_open"):
    @query(name, agg_sql(EVENTS, HOUR, ("event_type",), ("count", "max"), ("value",), where))
    def run(spark, d):
        part = A.in_time(events(spark, d), EVENTS, start, end, bounds)
        return A.bucket_agg(part, EVENTS, HOUR, ("event_type",), ("count", "max"), ("value",))


_ranged("range_absolute", RANGE, T0, T2)
_ranged("range_open_end", f"ts >= {_at(T1)}", T1, None)
_ranged("range_relative", f"ts >= {_at(NOW - 14 * DAY)} AND ts < {_at(NOW - DAY)}", *resolve_relative("14d", "1d", NOW))

# ---- aggregation -------------------------------------------------------------------------------------


def _bucketed(name: str, fns, tags=EVENTS.tags, window=HOUR):
    @query(name, agg_sql(EVENTS, window, tags, fns, EVENTS.fields))
    def run(spark, d):
        return rounded(A.bucket_agg(events(spark, d), EVENTS, window, tags, fns))


for _fn in ("mean", "sum", "min", "max", "count"):
    _bucketed(f"bucket_agg_{_fn}", (_fn,))
_bucketed("bucket_agg_time_only", ("mean", "count"), ())
_bucketed("bucket_median", ("median",), ("event_type",))
_bucketed("bucket_first_last", ("first", "last"), ("event_type",))


@query("bucket_approx_median", agg_sql(EVENTS, HOUR, ("event_type",), ("approx_median",), EVENTS.fields))
def bucket_approx_median(spark, d):
    """From sketches; groups of up to ten thousand values are exact."""
    return rounded(A.bucket_agg(events(spark, d), EVENTS, HOUR, ("event_type",), ("approx_median",)))


@query("median_spread", agg_sql(EVENTS, WEEK, ("event_type",), ("median",), EVENTS.fields))
def median_spread(spark, d):
    """Medians of groups of more values than are sorted in one place."""
    return rounded(exact_median(events(spark, d), EVENTS, WEEK, ("event_type",), few=200))


@query("bucket_first_last_ties", agg_sql(LINEITEM, 28 * DAY, LINEITEM.tags, ("first", "last"), LINEITEM.fields))
def bucket_first_last_ties(spark, d):
    """Day-grain times: ties decide nearly every first and last."""
    return A.bucket_agg(lineitem(spark, d), LINEITEM, 28 * DAY, LINEITEM.tags, ("first", "last"))


def _grid_sql(window: int, tags: str, inner: str, measures: str) -> str:
    low, high = T0 // window * window, -(-T2 // window) * window
    keys = " AND ".join(f"g.{t} = a.{t}" for t in tags.split(", "))
    return f"WITH a AS ({inner}), s AS (SELECT DISTINCT {tags} FROM a), g AS (SELECT {_at(0)} + INTERVAL 1 second * t AS bucket, {tags} FROM s, (SELECT unnest(range({low}, {high}, {window})) AS t)) SELECT g.bucket, {', '.join('g.' + t for t in tags.split(', '))}, {measures} FROM g LEFT JOIN a ON g.bucket = a.bucket AND {keys}"


@query("bucket_empty", _grid_sql(HOUR, "event_type, user_id", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean",), ("value",), RANGE), "mean_value"))
def bucket_empty(spark, d):
    part = A.in_time(events(spark, d), EVENTS, T0, T2)
    return rounded(A.bucket_agg(part, EVENTS, HOUR, EVENTS.tags, ("mean",), ("value",), create_empty=True, start=T0, end=T2))


@query("label_window_end", agg_sql(EVENTS, HOUR, ("event_type",), ("count",), ("value",), extra=f" + INTERVAL '{HOUR} seconds'"))
def label_window_end(spark, d):
    return A.bucket_agg(events(spark, d), EVENTS, HOUR, ("event_type",), ("count",), ("value",), label="end")


@query("group_series", f"SELECT event_type, user_id, count(*) AS buckets, min(bucket) AS first_bucket, max(bucket) AS last_bucket FROM ({agg_sql(EVENTS, DAY, EVENTS.tags, ('count',), ('value',))}) GROUP BY 1, 2")
def group_series(spark, d):
    return A.group_series(A.bucket_agg(events(spark, d), EVENTS, DAY, EVENTS.tags, ("count",), ("value",)), EVENTS.tags)


@query("order_result", agg_sql(EVENTS, DAY, EVENTS.tags, ("count",), ("value",)))
def order_result(spark, d):
    return A.order_result(A.bucket_agg(events(spark, d), EVENTS, DAY, EVENTS.tags, ("count",), ("value",)), EVENTS.tags)


# ---- rollups ----------------------------------------------------------------------------------------------

_DOC = {
    "bucket": "b", "table": "events", "range": {"start": T0, "end": T2}, "relativeRange": None, "yield": "y", "doTrace": False, "measurements": ["value", "k"], "groupKeys": ["event_type"],
    "filters": [{"type": "or", "filter": [{"key": "event_type", "value": "click"}, {"key": "event_type", "value": "view"}]}], "aggregate": {"timeWindow": "1h", "aggFunc": "mean"},
}


@query("run_query", agg_sql(EVENTS, HOUR, ("event_type",), ("mean",), ("value", "k"), f"{IN} AND {RANGE}"))
def run_query_(spark, d):
    return rounded(run_query(events(spark, d), EVENTS, _DOC))


_AF = Or(Eq("l_returnflag", "A"), Eq("l_returnflag", "N"))
#: Seven panels over two tags and three fields: fields, days, range and tags vary from panel to panel.
SUITE = {
    f"q{i + 1}": MetricQuery("lineitem", tuple(f"l_{f}" for f in fields.split()), "mean", days * DAY, tags, (_AF,), start, L2)
    for i, (fields, days, start, tags) in enumerate([
        ("quantity extendedprice", 7, L1, LINEITEM.tags), ("quantity discount", 7, L1, LINEITEM.tags), ("quantity extendedprice", 7, L0, LINEITEM.tags), ("quantity discount", 7, L0, ("l_returnflag",)),
        ("quantity", 14, L0, LINEITEM.tags), ("quantity extendedprice", 28, L0, ("l_returnflag",)), ("quantity extendedprice discount", 28, L0, ("l_linestatus",)),
    ])
}


def _long(df: DataFrame, name: str) -> DataFrame:
    """An answer as rows (query, bucket, series, measure, value)."""
    measures = [c for c in df.columns if c.startswith("mean_")]
    tags = [c for c in df.columns if c not in (*measures, "bucket")]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]))
    return df.select(F.lit(name).alias("query"), "bucket", F.concat_ws("/", *sorted(tags)).alias("series"), cells.alias("c")).select("query", "bucket", "series", "c.*")


def _suite_sql() -> str:
    parts = []
    for name, q in SUITE.items():
        where = f"l_returnflag IN ('A', 'N') AND l_shipdate >= {_at(q.start)} AND l_shipdate < {_at(q.end)}"
        for f in q.fields:
            parts.append(f"SELECT '{name}' AS query, {_bucket(q.window, 'l_shipdate')} AS bucket, concat_ws('/', {', '.join(sorted(q.tags))}) AS series, 'mean_{f}' AS measure, {SQL_FN['mean'].format(f)} AS value FROM lineitem WHERE {where} GROUP BY 2, 3")
    return " UNION ALL ".join(parts)


@query("answer_suite", _suite_sql())
def answer_suite_(spark, d):
    out = None
    for name, df in answer_suite(lineitem(spark, d), LINEITEM, SUITE).items():
        out = _long(df, name) if out is None else out.unionByName(_long(df, name))
    return out


ALL_FNS = ("mean", "sum", "count", "min", "max", "first", "last")


def _events_rollup(spark, d, start=None, end=None, fns=ALL_FNS, window=600):
    return R.build_rollup(events(spark, d), EVENTS, window, EVENTS.tags, (), fns, start, end)


@query("rollup_build", agg_sql(EVENTS, 600, EVENTS.tags, ("count", "sum"), EVENTS.fields))
def rollup_build(spark, d):
    r = _events_rollup(spark, d, fns=("mean",))
    return rounded(r.df.select("bucket", *EVENTS.tags, *[F.col(f"{f}__n").alias(f"count_{f}") for f in EVENTS.fields], *[F.col(f"{f}__sum").cast("double").alias(f"sum_{f}") for f in EVENTS.fields]))


@query("rollup_finalize", agg_sql(EVENTS, 600, EVENTS.tags, ALL_FNS, EVENTS.fields))
def rollup_finalize(spark, d):
    return rounded(R.finalize(_events_rollup(spark, d), ALL_FNS))


@query("rollup_slice", agg_sql(EVENTS, 600, EVENTS.tags, ("mean",), ("value",), RANGE))
def rollup_slice(spark, d):
    return rounded(R.finalize(R.slice_rollup(_events_rollup(spark, d), T0, T2), ("mean",), ("value",)))


@query("rollup_regroup", agg_sql(EVENTS, 600, ("event_type",), ALL_FNS, ("value",)))
def rollup_regroup(spark, d):
    return rounded(R.finalize(R.regroup(_events_rollup(spark, d), ("event_type",)), ALL_FNS, ("value",)))


@query("rollup_downsample", agg_sql(EVENTS, DAY, EVENTS.tags, ALL_FNS, ("value",)))
def rollup_downsample(spark, d):
    return rounded(R.finalize(R.downsample(_events_rollup(spark, d), DAY), ALL_FNS, ("value",)))


@query("rollup_regroup_downsample", agg_sql(LINEITEM, 28 * DAY, ("l_returnflag",), ("mean", "sum", "count", "max"), LINEITEM.fields, f"l_shipdate >= {_at(L0)} AND l_shipdate < {_at(L2)}"))
def rollup_regroup_downsample(spark, d):
    r = R.build_rollup(lineitem(spark, d), LINEITEM, WEEK, LINEITEM.tags)
    part = R.slice_rollup(r, L0, L2)
    return rounded(R.finalize(R.regroup_downsample(part, ("l_returnflag",), 28 * DAY), ("mean", "sum", "count", "max")))


@query("rollup_union", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean",), ("value",)))
def rollup_union(spark, d):
    e = events(spark, d)
    types = ("click", "error", "purchase", "signup", "view")
    parts = [R.build_rollup(e, EVENTS, HOUR, EVENTS.tags, [Eq("event_type", t)]) for t in types]
    others = e.where(~F.coalesce(F.col("event_type").isin(*types), F.lit(False)))  # any other type, and none
    parts.append(R.build_rollup(others, EVENTS, HOUR, EVENTS.tags))
    return rounded(R.union_parts(*[R.finalize(p, ("mean",), ("value",)) for p in parts]))


@query("union_parts", agg_sql(EVENTS, DAY, ("event_type",), ("sum",), ("value",)))
def union_parts(spark, d):
    e = events(spark, d)
    cuts = [(None, T0), (T0, T1), (T1, T2), (T2, None)]
    return rounded(R.union_parts(*[A.bucket_agg(A.in_time(e, EVENTS, a, b), EVENTS, DAY, ("event_type",), ("sum",), ("value",)) for a, b in cuts]))


@query(
    "rollup_mean_of_means",
    f"WITH {EV}, a AS (SELECT {_bucket(600)} AS b, event_type, user_id, avg(value) AS m FROM ev GROUP BY ALL), c AS (SELECT b, event_type, avg(m) AS m FROM a GROUP BY ALL) SELECT {_bucket(HOUR, 'b')} AS bucket, event_type, round(avg(m), 6) AS mean_value FROM c GROUP BY ALL",
)
def rollup_mean_of_means(spark, d):
    out = R.answer(_events_rollup(spark, d, fns=("mean",)), "mean", HOUR, ("event_type",), ("value",), combine="values")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("rollup_median_guard", agg_sql(EVENTS, DAY, ("event_type",), ("median",), ("value",), RANGE))
def rollup_median_guard(spark, d):
    return rounded(R.answer(_events_rollup(spark, d, fns=("mean",)), "median", DAY, ("event_type",), ("value",), T0, T2, raw=events(spark, d)))


@query(
    "rollup_all_subsets",
    f"WITH {EV} SELECT {_bucket(DAY)} AS bucket, event_type, user_id, CAST(2 * grouping(event_type) + grouping(user_id) AS BIGINT) AS grouping, count(value) AS n, CAST(sum(CAST(value AS DECIMAL( 18, 2))) AS DOUBLE) AS s FROM ev GROUP BY GROUPING SETS ((1), (1, event_type), (1, user_id), (1, event_type, user_id))".replace("(1", f"({_bucket(DAY)}"),
)
def rollup_all_subsets(spark, d):
    out = R.rollup_lattice(R.downsample(_events_rollup(spark, d, fns=("mean",)), DAY), EVENTS.tags)
    return out.select("bucket", *EVENTS.tags, "grouping", F.col("value__n").alias("n"), F.col("value__sum").cast("double").alias("s"))


# ---- refresh -------------------------------------------------------------------------------------------------


@query("extend_end", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean", "count", "last"), ("value",), f"ts >= {_at(T0)} AND ts < {_at(T2 + 1800)}"))
def extend_end(spark, d):
    """From a range that ends inside a bucket to another such."""
    r = _events_rollup(spark, d, T0, T1 + 900, window=HOUR)
    return rounded(R.finalize(refresh.extend(r, events(spark, d), new_end=T2 + 1800), ("mean", "count", "last"), ("value",)))


@query("extend_start", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean", "count", "first"), ("value",), f"ts >= {_at(T0 - 1800)} AND ts < {_at(T2)}"))
def extend_start(spark, d):
    r = _events_rollup(spark, d, T1 + 900, T2, window=HOUR)
    return rounded(R.finalize(refresh.extend(r, events(spark, d), new_start=T0 - 1800), ("mean", "count", "first"), ("value",)))


@query("merge_delta", agg_sql(EVENTS, HOUR, EVENTS.tags, ALL_FNS, ("value", "k")))
def merge_delta(spark, d):
    """Every third point comes late, wherever its bucket."""
    e = events(spark, d)
    late = F.pmod("event_id", F.lit(3)) == 0
    r = R.build_rollup(e.where(~late), EVENTS, HOUR, EVENTS.tags, (), ALL_FNS)
    delta = R.build_rollup(e.where(late), EVENTS, HOUR, EVENTS.tags, (), ALL_FNS)
    return rounded(R.finalize(refresh.merge_states(r, delta.df), ALL_FNS))


@query("delta_at_rollup_grain", agg_sql(EVENTS, 600, EVENTS.tags, ("mean", "max"), EVENTS.fields, f"{IN} AND ts >= {_at(T1)} AND ts < {_at(T2)}"))
def delta_at_rollup_grain(spark, d):
    e = events(spark, d)
    r = R.build_rollup(e, EVENTS, 600, EVENTS.tags, [BOTH], ("mean", "max"), T0, T1)
    return rounded(R.finalize(refresh.delta_for(r, e, T1, T2), ("mean", "max")))


# ---- answers from a folder of rollups ---------------------------------------------------------------------------


def _served(spark, d, stored, asked):
    """Stores a rollup for each of ``stored`` (window, tags, start, end), then serves a daily mean and checks how it came about."""
    root, e = store.shared_folder(spark, "store"), events(spark, d)
    for window, tags, start, end in stored:
        r = R.build_rollup(e, EVENTS, window, tags, [BOTH], ("mean", "max"), start, end)
        store.save_rollup(r, store.place(root, r.meta))
    got = serve(root, e, EVENTS, MetricQuery("events", ("value",), "mean", DAY, ("event_type",), (BOTH,), T0, T2))
    if got.kind != asked:
        raise AssertionError(f"{got.kind}, not {asked}")
    return got.df


_SERVED = agg_sql(EVENTS, DAY, ("event_type",), ("mean",), ("value",), f"{IN} AND {RANGE}")


@query("serve_hit", _SERVED)
def serve_hit(spark, d):
    """Of two stored rollups the coarser one is taken; no raw point is read."""
    return _served(spark, d, [(600, EVENTS.tags, T0 - DAY, T2), (HOUR, EVENTS.tags, T0, T2 + DAY)], "hit")


@query("serve_extend", _SERVED)
def serve_extend(spark, d):
    """A rollup that lacks both ends, one of them from inside a bucket, is extended on disk."""
    return _served(spark, d, [(HOUR, EVENTS.tags, T0 + DAY + 1800, T1 + 5 * HOUR + 900)], "extend")


@query("serve_miss", _SERVED)
def serve_miss(spark, d):
    """What is stored has a window that does not divide the asked one: a new rollup is built and stored."""
    return _served(spark, d, [(HOUR * 7, EVENTS.tags, T0, T2)], "miss")


_ASKED = MetricQuery("events", ("value",), "mean", DAY, ("event_type",), (BOTH,), T0, T2)


def _stored(spark, points, root, window, tags, start, end, fns=("mean", "max")):
    r = R.build_rollup(points, EVENTS, window, tags, [BOTH], fns, start, end)
    store.save_rollup(r, store.place(root, r.meta))


def _came(got, kind: str):
    if got.kind != kind:
        raise AssertionError(f"{got.kind}, not {kind}")
    return got.df


@query("serve_late", agg_sql(EVENTS, DAY, ("event_type",), ("mean", "max"), ("value", "k"), f"{IN} AND {RANGE}"))
def serve_late(spark, d):
    """Every fifth point comes after two rollups of its range were stored; a batch of them is merged into both, and sent once more."""
    root, e = store.shared_folder(spark, "store"), events(spark, d)
    late = e.where(F.pmod("event_id", F.lit(5)) == 0)
    for window, tags in ((600, EVENTS.tags), (HOUR, ("event_type",))):
        _stored(spark, e.where(F.pmod("event_id", F.lit(5)) != 0), root, window, tags, T0, T2 + 1800)
    if [absorb(root, late, EVENTS, "late points"), absorb(root, late, EVENTS, "late points")] != [2, 0]:
        raise AssertionError("a batch must be merged once into each rollup")
    ask = lambda fn: _came(serve(root, e, EVENTS, MetricQuery("events", ("*",), fn, DAY, ("event_type",), (BOTH,), T0, T2)), "hit")
    return ask("mean").join(ask("max"), ["bucket", "event_type"])


@query("serve_fields", agg_sql(EVENTS, DAY, ("event_type",), ("mean",), ("value", "k"), f"{IN} AND {RANGE}"))
def serve_fields(spark, d):
    """Two panels ask one field each: the first one builds a rollup of all fields, the second is a hit."""
    root, e = store.shared_folder(spark, "store"), events(spark, d)
    ask = lambda field, kind: _came(serve(root, e, EVENTS, MetricQuery("events", (field,), "mean", DAY, ("event_type",), (BOTH,), T0, T2)), kind)
    return ask("value", "miss").join(ask("k", "hit"), ["bucket", "event_type"])


@query("serve_cover", _SERVED)
def serve_cover(spark, d):
    """Two rollups of other tags and windows cover the range together: no raw point is read."""
    root, e = store.shared_folder(spark, "store"), events(spark, d)
    _stored(spark, e, root, 600, EVENTS.tags, T0 - HOUR, T1 + 2 * DAY + HOUR)
    _stored(spark, e, root, HOUR, ("event_type",), T1, T2 + DAY)
    return _came(serve(root, e, EVENTS, _ASKED), "cover")


@query("serve_gap", _SERVED)
def serve_gap(spark, d):
    """Between two rollups three days are missing: these alone are aggregated."""
    root, e = store.shared_folder(spark, "store"), events(spark, d)
    _stored(spark, e, root, 600, EVENTS.tags, T0 - HOUR, T1)
    _stored(spark, e, root, HOUR, ("event_type",), T1 + 3 * DAY, T2 + DAY)
    got = serve(root, e, EVENTS, _ASKED)
    if got.read != ((T1, T1 + 3 * DAY),):
        raise AssertionError(f"read {got.read}")
    return _came(got, "extend")


@query("serve_empty", _grid_sql(HOUR, "event_type", agg_sql(EVENTS, HOUR, ("event_type",), ("mean",), ("value",), f"{IN} AND {RANGE}"), "mean_value"))
def serve_empty(spark, d):
    """Windows without points, from a stored rollup."""
    root, e = store.shared_folder(spark, "store"), events(spark, d)
    _stored(spark, e, root, 600, EVENTS.tags, T0 - DAY, T2)
    return _came(serve(root, e, EVENTS, MetricQuery("events", ("value",), "mean", HOUR, ("event_type",), (BOTH,), T0, T2, create_empty=True)), "hit")


@query("snapshot_read", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean", "count"), ("value", "k"), f"ts >= {_at(T0)} AND ts < {_at(T1)}"))
def snapshot_read(spark, d):
    """An answer that was taken before its rollup grew, and before a part of it was computed anew, reads what it was taken from."""
    path, e = store.shared_folder(spark, "rollup"), events(spark, d)
    store.save_rollup(R.build_rollup(e, EVENTS, HOUR, EVENTS.tags, start=T0, end=T1), path)
    before = R.finalize(store.load_rollup(spark, path, EVENTS), ("mean", "count"))
    store.save_rollup(R.build_rollup(e.where("event_type <> 'click'"), EVENTS, HOUR, EVENTS.tags, start=T0 + DAY, end=T2), path)
    return before


@query("load_one_tag", agg_sql(EVENTS, DAY, ("event_type",), ("mean", "count"), ("value",), "user_id = '7'"))
def load_one_tag(spark, d):
    """From a rollup that is clustered by its tags: one user's rows lie in few of the files."""
    path, e = store.shared_folder(spark, "rollup"), events(spark, d)
    store.save_rollup(R.build_rollup(e, EVENTS, DAY, EVENTS.tags, (), ("mean", "count")), path)
    store.cluster(spark, path, rows_per_file=200)
    one = store.load_rollup(spark, path, EVENTS, where={"user_id": "7"})
    return rounded(R.finalize(R.regroup(one, ("event_type",)), ("mean", "count"), ("value",)))


@query("save_part", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean", "count"), ("value", "k")))
def save_part(spark, d):
    """A part that starts and ends inside days is stored over the whole: nothing else of those days is lost."""
    path = _saved(spark, d)
    store.save_rollup(R.build_rollup(events(spark, d), EVENTS, HOUR, EVENTS.tags, start=T1 + 13 * HOUR, end=T2 + 5 * HOUR + 60), path)
    return rounded(R.finalize(store.load_rollup(spark, path, EVENTS), ("mean", "count")))


# ---- series --------------------------------------------------------------------------------------------------------


@query("series_key", f"WITH {EV} SELECT event_id, 'event_type=' || event_type || ',user_id=' || user_id AS series FROM ev")
def series_key(spark, d):
    return events(spark, d).select("event_id", C.series_key(("user_id", "event_type", "_internal")).alias("series"))


_DAYS = agg_sql(EVENTS, HOUR, EVENTS.tags, ("count",), ("value",))


@query(
    "series_catalog",
    f"WITH b AS ({_DAYS}), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY bucket DESC) AS n FROM b) SELECT event_type, user_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket, max(bucket) FILTER (WHERE n = 2) AS second_last, count(*) AS buckets, 'event_type=' || event_type || ',user_id=' || user_id AS series FROM r GROUP BY event_type, user_id",
)
def series_catalog(spark, d):
    return series.series_catalog(R.build_rollup(events(spark, d), EVENTS, HOUR, EVENTS.tags, fns=("count",)).df, EVENTS.tags)


@query("top_2_buckets", f"WITH b AS ({_DAYS}) SELECT event_type, user_id, bucket, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY bucket DESC) AS INTEGER) AS rank FROM b QUALIFY rank <= 2")
def top_2_buckets(spark, d):
    return series.top_buckets(R.build_rollup(events(spark, d), EVENTS, HOUR, EVENTS.tags, fns=("count",)).df, EVENTS.tags)


@query("to_epoch_seconds", "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, CAST(epoch_us(ts) AS BIGINT) * 1000 AS ns FROM events")
def to_epoch_seconds(spark, d):
    return events(spark, d).select("event_id", C.to_epoch(F.col("ts")).alias("s"), C.to_epoch(F.col("ts"), "ns").alias("ns"))


def _index(spark, d):
    """One description per order: its status and priority as filters, its clerk-like group, its measure."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    described = o.select(
        F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("o_orderstatus="), "o_orderstatus"), F.concat(F.lit("o_orderpriority="), "o_orderpriority")).alias("filter"),
        F.when(F.col("o_custkey") % 2 == 0, "mean").otherwise("max").alias("aggregation"), F.array(F.lit("o_orderstatus")).alias("group"), F.lit("ignored").alias("comment"),
    )
    return series.index_build(described, "id")


_IX = "ix AS (SELECT 'filter' AS type, 'o_orderstatus=' || o_orderstatus AS word, o_orderkey AS id FROM orders UNION SELECT 'filter', 'o_orderpriority=' || o_orderpriority, o_orderkey FROM orders UNION SELECT 'aggregation', CASE WHEN o_custkey % 2 = 0 THEN 'mean' ELSE 'max' END, o_orderkey FROM orders UNION SELECT 'group', 'o_orderstatus', o_orderkey FROM orders)"


@query("index_build", f"WITH {_IX} SELECT type, word, id FROM ix")
def index_build(spark, d):
    return series.postings(_index(spark, d))


@query("index_search_word", f"WITH {_IX} SELECT DISTINCT id FROM ix WHERE type = 'filter' AND word = 'o_orderstatus=P'")
def index_search_word(spark, d):
    return series.search_word(_index(spark, d), "filter", "o_orderstatus=P")


@query("index_search_all", f"WITH {_IX} SELECT id FROM ix WHERE type = 'filter' AND word IN ('o_orderstatus=F', 'o_orderpriority=5-LOW') GROUP BY id HAVING count(DISTINCT word) = 2")
def index_search_all(spark, d):
    return series.search_all(_index(spark, d), "filter", ["o_orderstatus=F", "o_orderpriority=5-LOW"])


@query("index_search_tree", "SELECT o_orderkey AS id FROM orders WHERE (o_orderstatus = 'P' OR o_orderstatus = 'F') AND (o_orderpriority = '5-LOW' OR (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'))")
def index_search_tree(spark, d):
    low, high = Eq("o_orderpriority", "5-LOW"), Eq("o_orderpriority", "2-HIGH")
    tree = And(Or(Eq("o_orderstatus", "P"), Eq("o_orderstatus", "F")), Or(low, And(Eq("o_orderstatus", "F"), high)))
    return series.search_tree(_index(spark, d), tree)


@query("index_match", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0")
def index_match(spark, d):
    return series.match(_index(spark, d), {"filter": ["o_orderstatus=O", "o_orderpriority=1-URGENT"], "aggregation": "mean", "group": "o_orderstatus"})


# ---- gaps ---------------------------------------------------------------------------------------------------------------


@query("fill_grid", _grid_sql(DAY, "event_type, user_id", agg_sql(EVENTS, DAY, EVENTS.tags, ("count", "sum"), ("value",), RANGE), "coalesce(count_value, 0) AS count_value, sum_value"))
def fill_grid(spark, d):
    out = A.bucket_agg(A.in_time(events(spark, d), EVENTS, T0, T2), EVENTS, DAY, EVENTS.tags, ("count", "sum"), ("value",))
    return rounded(gapfill.fill_grid(out, EVENTS.tags, T0, T2, DAY, count_zero=True, max_rows=100_000_000))


_EDGE = f"WITH a AS ({agg_sql(EVENTS, HOUR, EVENTS.tags, ('count',), ('value',), RANGE)}), s AS (SELECT event_type, user_id, CAST(epoch(min(bucket)) AS BIGINT) AS a, CAST(epoch(max(bucket)) AS BIGINT) AS b FROM a GROUP BY ALL)"
_EDGE += f", h AS (SELECT event_type, user_id, unnest(range(1, CASE WHEN a - {T0} > {HOUR} THEN (a - {T0}) // {HOUR} + 2 ELSE 1 END)) AS i, a FROM s), t AS (SELECT event_type, user_id, unnest(range(1, CASE WHEN {T2} - b > {HOUR} THEN ({T2} - b) // {HOUR} + 1 ELSE 1 END)) AS i, b FROM s)"


@query("fill_edges", f"{_EDGE} SELECT bucket, event_type, user_id, count_value FROM a UNION ALL SELECT {_at(0)} + INTERVAL 1 second * (a - i * {HOUR}), event_type, user_id, NULL FROM h UNION ALL SELECT {_at(0)} + INTERVAL 1 second * (b + i * {HOUR}), event_type, user_id, NULL FROM t")
def fill_edges(spark, d):
    out = A.bucket_agg(A.in_time(events(spark, d), EVENTS, T0, T2), EVENTS, HOUR, EVENTS.tags, ("count",), ("value",))
    return gapfill.fill_edges(out, EVENTS.tags, T0, T2, HOUR)


# ---- a log of queries against a catalog of rollups ------------------------------------------------------------------------


def query_log(spark, d):
    """A log made from orders: one query document per order, whose parts follow from the order's columns."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    leaf = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    one, two = leaf("status", F.col("o_orderstatus")), leaf("priority", F.col("o_orderpriority"))
    swap = k % 2 == 0
    filters = F.array(F.struct(F.when(c % 2 == 0, "or").otherwise("and").alias("type"), F.when(swap, F.array(one, two)).otherwise(F.array(two, one)).alias("filter")))
    start = F.lit(1_700_000_000) + (c % 50) * 600
    doc = F.struct(
        F.lit("b").alias("bucket"), F.lit("m").alias("table"), F.concat(F.lit("y"), (k % 3).cast("string")).alias("yield"), F.struct(start.cast("long").alias("start"), (start + 3600 + (k % 40) * 600).cast("long").alias("end")).alias("range"),
        filters.alias("filters"), F.array(F.lit("v")).alias("measurements"), F.when(k % 3 == 0, F.array(F.lit("host"))).when(k % 3 == 1, F.array(F.lit("platform"), F.lit("host"))).otherwise(F.array().cast("array<string>")).alias("groupKeys"),
        F.struct(F.element_at(F.array(*[F.lit(x) for x in ("1m", "10m", "90s", "1h")]), (k % 4 + 1).cast("int")).alias("timeWindow"), F.when(c % 5 == 0, "median").otherwise("mean").alias("aggFunc")).alias("aggregate"),
    )
    return o.select(k.alias("query_id"), F.to_json(doc).alias("doc"))


_LOG = """log AS (SELECT o_orderkey AS query_id, 'b' AS bucket, 'm' AS "table", 'y' || (o_orderkey % 3) AS yield, 1700000000 + (o_custkey % 50) * 600 AS q_start, 1700000000 + (o_custkey % 50) * 600 + 3600 + (o_orderkey % 40) * 600 AS q_end,
    CASE WHEN o_orderkey % 3 = 0 THEN ['host'] WHEN o_orderkey % 3 = 1 THEN ['host', 'platform'] ELSE CAST([] AS VARCHAR[]) END AS tags, CASE WHEN o_custkey % 5 = 0 THEN 'median' ELSE 'mean' END AS agg_fn,
    CASE o_orderkey % 4 WHEN 0 THEN '1m' WHEN 1 THEN '10m' WHEN 2 THEN '90s' ELSE '1h' END AS window_text, CAST(CASE o_orderkey % 4 WHEN 0 THEN 60 WHEN 1 THEN 600 WHEN 2 THEN 90 ELSE 3600 END AS BIGINT) AS window_s, FALSE AS create_empty,
    CASE WHEN o_custkey % 2 = 0 THEN 'or' ELSE 'and' END AS op, 'status=' || o_orderstatus AS f1, 'priority=' || o_orderpriority AS f2, o_orderkey % 2 = 0 AS swap FROM orders),
    keyed AS (SELECT *, "table" || '|' || agg_fn || '|' || op || '(' || f2 || ',' || f1 || ')' AS fingerprint, bucket || '|' || op || '(' || CASE WHEN swap THEN f1 || ',' || f2 ELSE f2 || ',' || f1 END || ')|' || yield || '|' || window_text || '|' || agg_fn || '|false' AS exact_key FROM log)"""

_CAT = """cat AS (SELECT CAST(n * 2 + v AS BIGINT) AS rollup_id, fingerprint, CASE WHEN v = 0 THEN ['host', 'platform'] ELSE ['host'] END AS r_tags, CAST(CASE WHEN v = 0 THEN 60 ELSE 600 END AS BIGINT) AS r_window,
    CAST(1700000000 + 600 * (6 + 4 * v) AS BIGINT) AS r_start, CAST(1700000000 + 600 * (40 + 8 * v) AS BIGINT) AS r_end FROM (SELECT fingerprint, row_number() OVER (ORDER BY fingerprint) AS n FROM (SELECT DISTINCT fingerprint FROM keyed)), (VALUES (0), (1)) t(v))"""


def _keyed(spark, d, exact: bool = False):
    log = reuse.query_fingerprint(reuse.parse_query_log(query_log(spark, d)))
    return reuse.exact_query_key(log) if exact else log


def catalog(log: DataFrame) -> DataFrame:
    """Two rollups per fingerprint: a fine one with both tags and a coarse one with one, over different ranges."""
    from pyspark.sql import Window

    keys = log.select("fingerprint").distinct().withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("fingerprint")).cast("long"))
    v = F.explode(F.array(F.lit(0), F.lit(1))).alias("v")
    return keys.select("fingerprint", "n", v).select(
        (F.col("n") * 2 + F.col("v")).alias("rollup_id"), "fingerprint", F.when(F.col("v") == 0, F.array(F.lit("host"), F.lit("platform"))).otherwise(F.array(F.lit("host"))).alias("r_tags"),
        F.when(F.col("v") == 0, 60).otherwise(600).cast("long").alias("r_window"), (1_700_000_000 + 600 * (6 + 4 * F.col("v"))).cast("long").alias("r_start"), (1_700_000_000 + 600 * (40 + 8 * F.col("v"))).cast("long").alias("r_end"),
    )


@query("parse_query_log", f"""WITH {_LOG} SELECT query_id, bucket, "table", yield, CAST(q_start AS BIGINT) AS q_start, CAST(q_end AS BIGINT) AS q_end, array_to_string(tags, ',') AS tags, agg_fn, window_text, window_s, create_empty FROM log""")
def parse_query_log(spark, d):
    return reuse.parse_query_log(query_log(spark, d)).drop("filters", "measurements").withColumn("tags", F.array_join("tags", ","))


@query("duration_seconds", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_custkey AS BIGINT) * [1, 60, 3600, 86400, 604800, 31536000][o_orderkey % 7 + 1] END AS s FROM orders")
def duration_seconds(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhdwyx"]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select("o_orderkey", C.duration_seconds(F.concat(F.col("o_custkey").cast("string"), unit)).alias("s"))


@query("query_fingerprint", f"WITH {_LOG} SELECT query_id, fingerprint FROM keyed")
def query_fingerprint(spark, d):
    return _keyed(spark, d).select("query_id", "fingerprint")


@query("exact_query_key", f"WITH {_LOG} SELECT query_id, exact_key FROM keyed")
def exact_query_key(spark, d):
    return _keyed(spark, d, exact=True).select("query_id", "exact_key")


_MATCH = """matched AS (SELECT keyed.*, cat.* EXCLUDE (fingerprint) FROM keyed JOIN cat USING (fingerprint) WHERE list_has_all(r_tags, tags) AND window_s % r_window = 0 AND (agg_fn <> 'median' OR (list_sort(tags) = list_sort(r_tags) AND window_s = r_window)))"""
_CLASS = """classed AS (SELECT *, CASE WHEN kind = 'hit' THEN NULL WHEN kind = 'end' THEN CAST(floor(r_end / r_window) AS BIGINT) * r_window ELSE CAST(floor(q_start / r_window) AS BIGINT) * r_window END AS missing_start,
    CASE WHEN kind = 'hit' THEN NULL WHEN kind = 'start' THEN CAST(ceil(r_start / r_window) AS BIGINT) * r_window ELSE CAST(ceil(q_end / r_window) AS BIGINT) * r_window END AS missing_end FROM
    (SELECT *, CASE WHEN q_end <= r_start OR q_start >= r_end OR (q_start < r_start - r_window AND q_end > r_end + r_window) THEN 'full' WHEN q_start < r_start - r_window THEN 'start' WHEN q_end > r_end + r_window THEN 'end' ELSE 'hit' END AS kind FROM matched))"""


def _matched(spark, d):
    """The parsed log, written once: matching reads it for its keys, its shapes and its rows."""
    log = _keyed(spark, d).select("query_id", *reuse.SHAPE, "q_start", "q_end")
    path = store.shared_folder(spark, "log")
    log.write.parquet(path)
    log = spark.read.schema(log.schema).parquet(path)
    return reuse.reuse_match(log, catalog(log))


@query("reuse_match", f"WITH {_LOG}, {_CAT}, {_MATCH} SELECT query_id, rollup_id FROM matched")
def reuse_match(spark, d):
    return _matched(spark, d).select("query_id", "rollup_id")


@query("missing_range", f"WITH {_LOG}, {_CAT}, {_MATCH}, {_CLASS} SELECT query_id, rollup_id, kind, CASE kind WHEN 'hit' THEN NULL WHEN 'end' THEN r_end ELSE q_start END AS \"start\", CASE kind WHEN 'hit' THEN NULL WHEN 'start' THEN r_start ELSE q_end END AS \"end\" FROM classed")
def missing_range(spark, d):
    m = C.missing_range(F.col("q_start"), F.col("q_end"), F.col("r_start"), F.col("r_end"), F.col("r_window"))
    return _matched(spark, d).select("query_id", "rollup_id", m.alias("m")).select("query_id", "rollup_id", "m.*")


@query("reuse_classify", f"WITH {_LOG}, {_CAT}, {_MATCH}, {_CLASS} SELECT query_id, rollup_id, kind, missing_start, missing_end, coalesce(missing_end - missing_start, 0) AS missing_s FROM classed")
def reuse_classify(spark, d):
    return reuse.reuse_classify(_matched(spark, d)).select("query_id", "rollup_id", "kind", "missing_start", "missing_end", "missing_s")


@query("reuse_best", f"WITH {_LOG}, {_CAT}, {_MATCH}, {_CLASS} SELECT query_id, rollup_id, kind, coalesce(missing_end - missing_start, 0) AS missing_s FROM classed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(missing_end - missing_start, 0), r_window DESC, rollup_id) = 1")
def reuse_best(spark, d):
    return reuse.reuse_best(reuse.reuse_classify(_matched(spark, d))).select("query_id", "rollup_id", "kind", "missing_s")


@query("reuse_summary", f"WITH {_LOG}, {_CAT}, {_MATCH}, {_CLASS} SELECT fingerprint, count(*) AS queries, count_if(kind = 'hit') AS hits, count_if(kind IN ('start', 'end')) AS partial, CAST(sum(coalesce(missing_end - missing_start, 0)) AS BIGINT) AS missing_s, round(avg(CASE WHEN kind = 'hit' THEN 1.0 ELSE 0.0 END), 6) AS hit_ratio FROM classed GROUP BY 1".replace("count_if(kind = 'hit')", "count(*) FILTER (WHERE kind = 'hit')").replace("count_if(kind IN ('start', 'end'))", "count(*) FILTER (WHERE kind IN ('start', 'end'))"))
def reuse_summary(spark, d):
    return rounded(reuse.reuse_summary(reuse.reuse_classify(_matched(spark, d)), ("fingerprint",)))


_CHAIN = """cat AS (SELECT CAST(n * 4 + v AS BIGINT) AS rollup_id, fingerprint, CASE WHEN v % 2 = 0 THEN ['host', 'platform'] ELSE ['host'] END AS r_tags, CAST(CASE WHEN v < 2 THEN 60 ELSE 600 END AS BIGINT) AS r_window,
    CAST(1700000000 + 600 * (3 + 13 * v) + 77 AS BIGINT) AS r_start, CAST(1700000000 + 600 * (24 + 13 * v) + 77 AS BIGINT) AS r_end FROM (SELECT fingerprint, row_number() OVER (ORDER BY fingerprint) AS n FROM (SELECT DISTINCT fingerprint FROM keyed)), (VALUES (0), (1), (2), (3)) t(v))"""


def _chained(log: DataFrame) -> DataFrame:
    """Four rollups per fingerprint whose ranges follow each other with overlaps."""
    from pyspark.sql import Window

    keys = log.select("fingerprint").distinct().withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("fingerprint")).cast("long"))
    v = F.col("v")
    start = (1_700_000_000 + 600 * (3 + 13 * v) + 77).cast("long")
    return keys.withColumn("v", F.explode(F.array(*[F.lit(k) for k in range(4)]))).select(
        (F.col("n") * 4 + v).alias("rollup_id"), "fingerprint", F.when(v % 2 == 0, F.array(F.lit("host"), F.lit("platform"))).otherwise(F.array(F.lit("host"))).alias("r_tags"),
        F.when(v < 2, 60).otherwise(600).cast("long").alias("r_window"), start.alias("r_start"), (start + 600 * 21).alias("r_end"),
    )


@query(
    "reuse_cover",
    f"""WITH RECURSIVE {_LOG}, {_CHAIN}, {_MATCH}, q AS (SELECT query_id, q_start // window_s * window_s AS low, (q_end + window_s - 1) // window_s * window_s AS high, window_s FROM log),
    iv AS (SELECT query_id, rollup_id, matched.r_window AS w, greatest((r_start + window_s - 1) // window_s * window_s, low) AS a, least(r_end // window_s * window_s, high) AS b FROM matched JOIN q USING (query_id, window_s)),
    walk AS (SELECT query_id, low AS pos, high, CAST(0 AS BIGINT) AS missing, CAST('' AS VARCHAR) AS picks, CAST(0 AS BIGINT) AS n FROM q
        UNION ALL
        SELECT query_id, coalesce(best.b, nxt), high, missing + CASE WHEN best.b IS NULL THEN nxt - pos ELSE 0 END, picks || CASE WHEN best.b IS NULL THEN '' ELSE ',' || (-best.i) END, n + CASE WHEN best.b IS NULL THEN 0 ELSE 1 END
        FROM (SELECT walk.query_id, walk.pos, walk.high, walk.missing, walk.picks, walk.n, max(CASE WHEN a <= pos AND b > pos THEN struct_pack(b := b, w := w, i := -rollup_id) END) AS best, coalesce(min(CASE WHEN a > pos AND b > a THEN a END), walk.high) AS nxt
            FROM walk LEFT JOIN iv ON iv.query_id = walk.query_id WHERE walk.pos < walk.high GROUP BY 1, 2, 3, 4, 5, 6))
    SELECT query_id, substr(picks, 2) AS rollups, n AS n_rollups, CAST(high - low - missing AS BIGINT) AS covered_s, CAST(missing AS BIGINT) AS missing_s FROM walk JOIN (SELECT query_id, low FROM q) USING (query_id) WHERE pos >= high""",
)
def reuse_cover(spark, d):
    """Queries answered from several stored ranges: which rollups cover each, and what is missing."""
    log = _keyed(spark, d).select("query_id", *reuse.SHAPE, "q_start", "q_end")
    path = store.shared_folder(spark, "log")
    log.write.parquet(path)
    log = spark.read.schema(log.schema).parquet(path)
    return reuse.reuse_cover(log, _chained(log)).withColumn("rollups", F.array_join("rollups", ","))


ADVICE = (600, HOUR, 2 * HOUR, DAY)


def _advice_sql(k: int) -> str:
    """Greedy choice, one pair of CTEs a round."""
    sets = [(tags, w) for w in ADVICE for tags in ((), ("event_type",), ("user_id",), ("event_type", "user_id"))]
    sizes = " UNION ALL ".join(f"SELECT [{', '.join(repr(t) for t in tags)}]::VARCHAR[] AS rt, {w} AS rw, count(*) AS size FROM (SELECT DISTINCT {', '.join([_bucket(w), *tags])} FROM ev)" for tags, w in sets)
    ctes = [EV, f"sizes AS ({sizes})", "l AS (SELECT ([[], ['event_type'], ['user_id'], ['event_type', 'user_id']]::VARCHAR[][])[o_orderkey % 4 + 1] AS tags, [600, 3600, 7200, 86400, 86400][o_custkey % 5 + 1] AS w FROM orders)",
        "c0 AS (SELECT struct_pack(t := tags, w := w) AS sh, count(*) AS n, (SELECT count(*) FROM ev) AS cost FROM l GROUP BY 1)", "pairs AS (SELECT sh, rt, rw, size FROM c0, sizes WHERE list_has_all(rt, sh.t) AND sh.w % rw = 0)"]
    for i in range(1, k + 1):
        ctes.append(f"p{i} AS (SELECT {i} AS pick, rt, rw, size, sum(n * greatest(cost - size, 0)) AS benefit FROM pairs JOIN c{i - 1} USING (sh) GROUP BY ALL ORDER BY benefit DESC, size, rt, rw LIMIT 1)")
        ctes.append(f"c{i} AS (SELECT c.sh, c.n, least(c.cost, min(q.size)) AS cost FROM c{i - 1} AS c LEFT JOIN (SELECT pairs.sh AS sh, pairs.size AS size FROM pairs JOIN p{i} ON pairs.rt = p{i}.rt AND pairs.rw = p{i}.rw) AS q ON q.sh = c.sh GROUP BY c.sh, c.n, c.cost)")
    picks = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, k + 1))
    return f"WITH {', '.join(ctes)} SELECT CAST(pick AS BIGINT) AS pick, array_to_string(rt, ',') AS r_tags, CAST(rw AS BIGINT) AS r_window, size AS rows, CAST(benefit AS BIGINT) AS benefit FROM ({picks}) WHERE benefit > 0"


@query("advise_rollups", _advice_sql(4))
def advise_rollups(spark, d):
    """Four rollups of events for a log of queries made from orders."""
    o, e = spark.read.parquet(f"{d}/orders.parquet"), events(spark, d)
    names = [[], ["event_type"], ["user_id"], ["event_type", "user_id"]]
    tags = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<string>") for ts in names])
    log = o.select(F.element_at(tags, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("tags"), F.element_at(F.array(*[F.lit(w).cast("long") for w in (*ADVICE, DAY)]), (F.col("o_custkey") % 5 + 1).cast("int")).alias("window_s"))
    sizes = advise.lattice_sizes(e, EVENTS, ADVICE, EVENTS.tags)
    return advise.advise_rollups(log, sizes, e.count(), 4).withColumn("r_tags", F.array_join("r_tags", ","))


@query(
    "set_logic",
    "WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS a, list_sort(list(DISTINCT CASE WHEN o_orderpriority < '3' THEN 'P' ELSE 'F' END)) AS b FROM orders GROUP BY 1) SELECT o_custkey, list_has_all(b, a) AS subset, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a FROM s",
)
def set_logic(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = o.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.when(F.col("o_orderpriority") < "3", "P").otherwise("F")).alias("b"))
    shown = lambda x: F.array_join(F.array_sort(x), ",")
    return s.select("o_custkey", C.is_subset(F.col("a"), F.col("b")).alias("subset"), shown(F.array_intersect("a", "b")).alias("both"), shown(F.array_union("a", "b")).alias("either"), shown(F.array_except("a", "b")).alias("only_a"))


# ---- audit, traces, streaming --------------------------------------------------------------------------------------------------


@query("audit_rollup", f"WITH {EV} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS differing FROM (SELECT DISTINCT {_bucket(HOUR)}, event_type FROM ev)")
def audit_rollup(spark, d):
    """A rollup's hourly answer against the one from raw points: no cell may differ."""
    left = R.answer(_events_rollup(spark, d), "mean", HOUR, ("event_type",))
    right = A.bucket_agg(events(spark, d), EVENTS, HOUR, ("event_type",))
    return audit.audit_rollup(left, right, ("event_type",), ("mean_value", "mean_k")).select("rows", "missing", "extra", "differing")


_OFF = f"event_type = 'view' AND ts >= {_at(T1 + DAY)} AND ts < {_at(T1 + 2 * DAY)}"
_WRONG = f"WITH {EV}, w AS (SELECT *, CASE WHEN {_OFF} THEN value + 1 ELSE value END AS off FROM ev WHERE {RANGE}), a AS (SELECT {_bucket(HOUR)} AS bucket, event_type, user_id, {SQL_FN['mean'].format('off')} AS s1, {SQL_FN['mean'].format('value')} AS f1, max(off) AS s2, max(value) AS f2 FROM w GROUP BY ALL)"


@query("audit_store", f"{_WRONG} SELECT bucket, event_type, user_id, 'mean_value' AS measure, s1 AS stored, f1 AS fresh FROM a WHERE abs(s1 - f1) > 1e-9 UNION ALL SELECT bucket, event_type, user_id, 'max_value', s2, f2 FROM a WHERE abs(s2 - f2) > 1e-9")
def audit_store(spark, d):
    """A store that is wrong for one type on one day: the cells are found, and only that day is compared."""
    path, e = store.shared_folder(spark, "rollup"), events(spark, d)
    built = R.build_rollup(e, EVENTS, HOUR, EVENTS.tags, (), ("mean", "max"), T0, T2, ("value",))
    # each value is off by 1, which changes states alone: a double plus 1 need not be one of the declared places (1.43 + 1 is 2.4299999999999997)
    wrong = (F.col("event_type") == "view") & C.in_range("bucket", T1 + DAY, T1 + 2 * DAY)
    off = {c: F.when(wrong, F.col(c) + more).otherwise(F.col(c)) for c, more in (("value__sum", F.col("value__n")), ("value__max", F.lit(1)))}
    store.save_rollup(replace(built, df=built.df.withColumns(off)), path)
    found = audit.audit_store(spark, path, EVENTS, e)
    if not set(found.compared) <= {(T1 + DAY, T1 + 2 * DAY)}:  # none where the day has no such points
        raise AssertionError(f"compared {found.compared}")
    return found.cells


@query("audit_mean_of_means", f"WITH {EV}, a AS (SELECT {_bucket(600)} AS b, event_type, user_id, avg(value) AS m FROM ev GROUP BY ALL), c AS (SELECT b, event_type, avg(m) AS m FROM a GROUP BY ALL), l AS (SELECT {_bucket(HOUR, 'b')} AS bucket, event_type, avg(m) AS m FROM c GROUP BY ALL), r AS (SELECT {_bucket(HOUR)} AS bucket, event_type, avg(value) AS m FROM ev GROUP BY ALL) SELECT count(*) AS rows, count(*) FILTER (WHERE abs(l.m - r.m) > 1e-6 * greatest(1.0, abs(r.m))) AS differing, round(max(abs(l.m - r.m)), 6) AS max_abs FROM l FULL JOIN r USING (bucket, event_type)")
def audit_mean_of_means(spark, d):
    """How far unweighted means of means are from the means."""
    left = R.answer(_events_rollup(spark, d, fns=("mean",)), "mean", HOUR, ("event_type",), ("value",), combine="values")
    right = A.bucket_agg(events(spark, d), EVENTS, HOUR, ("event_type",), ("mean",), ("value",))
    return rounded(audit.audit_rollup(left, right, ("event_type",), ("mean_value",), tol=1e-6).select("rows", "differing", "max_abs"))


@query("trace_collate", "WITH r AS (SELECT user_id, CAST(event_id % 4 AS INTEGER) AS position, event_type AS op, avg(value) AS s FROM events GROUP BY ALL) SELECT position, op, round(avg(s), 6) AS mean_s, round(median(s), 6) AS median_s, count(s) AS n FROM r GROUP BY ALL")
def trace_collate(spark, d):
    """Per user a list over four positions of maps from event type to its mean value."""
    e = events(spark, d)
    per = e.groupBy("user_id", (F.col("event_id") % 4).alias("p"), "event_type").agg(F.avg("value").alias("s"))
    maps = per.groupBy("user_id", "p").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("m"))
    found = maps.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "m"))).alias("by"))
    traces = found.select(F.transform(F.array(*[F.lit(i).cast("long") for i in range(4)]), lambda i: F.coalesce(F.col("by")[i], F.create_map().cast("map<string,double>"))).alias("traces"))
    out = audit.trace_collate(traces)
    return out.withColumn("mean_s", F.round("mean_s", 6)).withColumn("median_s", F.round("median_s", 6))


@query("latency_compare", "WITH r AS (SELECT event_type AS query, CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'cached' END AS mode, value AS s FROM events), m AS (SELECT query, median(s) FILTER (WHERE mode = 'raw') AS raw_s, median(s) FILTER (WHERE mode = 'cached') AS cached_s FROM r GROUP BY 1) SELECT query, round(raw_s, 6) AS raw_s, round(cached_s, 6) AS cached_s, round(1 - cached_s / raw_s, 6) AS saved FROM m")
def latency_compare(spark, d):
    e = events(spark, d)
    runs = e.select(F.col("event_type").alias("query"), F.when(F.col("event_id") % 2 == 0, "raw").otherwise("cached").alias("mode"), F.col("value").alias("s"))
    return rounded(audit.latency_compare(runs))


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(d_events(d))
    return stream.select("ts", "event_type", F.col("user_id").cast("string").alias("user_id"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_id")


def d_events(d: str) -> str:
    """A stream reads folders; the pattern also fits a table that is one file."""
    return f"{d}/events.parque[t]"


@query("stream_rollup", agg_sql(EVENTS, HOUR, ("event_type",), ("count", "max"), ("value",)))
def stream_rollup(spark, d):
    """All points through a stream in update mode; the sink keeps the latest row of each key."""
    path, check = store.shared_folder(spark, "stream"), store.shared_folder(spark, "stream-checkpoint")
    live = S.stream_rollup(_stream(spark, d), EVENTS, HOUR, ("event_type",), "40 days", ("count", "max"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={n}")

    live.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path).groupBy("bucket", "event_type").agg(F.max_by(F.struct("value__n", "value__max"), "batch_id").alias("s"))
    return rows.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", F.col("s.value__n").alias("count_value"), F.col("s.value__max").alias("max_value"))


@query("stream_served", _SERVED)
def stream_served(spark, d):
    """A stream into a catalogued rollup, whose last batch is committed twice as after a crash, answers a dashboard's query."""
    root, check = store.shared_folder(spark, "store"), store.shared_folder(spark, "stream-checkpoint")
    meta = S.upserted_meta(EVENTS, HOUR, EVENTS.tags, filters=(BOTH,))
    path = store.place(root, meta)
    S.stream_upsert(_stream(spark, d), EVENTS, HOUR, EVENTS.tags, path, check, filters=(BOTH,)).awaitTermination()
    last = store.snapshot(spark, path).ledger["stream"]
    if store.merge_rollup(R.build_rollup(events(spark, d), EVENTS, HOUR, EVENTS.tags, [BOTH]), path, "stream", last):
        raise AssertionError("a batch was merged twice")
    return _came(serve(root, events(spark, d), EVENTS, _ASKED), "hit")


@query("stream_upsert", agg_sql(EVENTS, HOUR, EVENTS.tags, ("mean", "count"), ("value",)))
def stream_upsert(spark, d):
    path, check = store.shared_folder(spark, "upsert"), store.shared_folder(spark, "upsert-checkpoint")
    S.stream_upsert(_stream(spark, d), EVENTS, HOUR, EVENTS.tags, path, check).awaitTermination()
    return rounded(R.finalize(S.read_upserted(spark, path, EVENTS, HOUR, EVENTS.tags), ("mean", "count"), ("value",)))
