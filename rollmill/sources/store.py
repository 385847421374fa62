"""Rollups on disk as snapshots, and a catalog of several rollups.

A rollup's folder holds ``data/v=<write>/date=<period>/`` with files that never change, and ``manifest/<version>.json``. A manifest
names the writes that make up each period (a day, or a year for windows of a day or more), what the rollup describes,
and which batches of late or streamed points it holds. A save writes new files, then one manifest: that is the commit. Before it the
old state stands, after it the new one; answers taken earlier still read their files, until ``vacuum`` finds them superseded for long enough.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable
from bisect import bisect_right
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import in_range, moment, to_epoch
from ..operators.rollup import merge_rows, union_parts
from ..spec import MetricTable, Rollup, RollupMeta, filter_from

CATALOG = "table string, agg_fn string, filter_key string, group_keys array<string>, window_s bigint, range_start bigint, range_end bigint"
#: Writes of one period that reads put together; more are compacted.
WRITES = 8
#: Seconds that superseded files stay for readers that began before.
KEEP = 86400
#: Saves that find another one committed meanwhile start anew so often.
ATTEMPTS = 5


class Conflict(RuntimeError):
    """Others kept committing to the same rollup."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a temporary one only in local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rollmill-")
    path = f"{base.rstrip('/')}/rollmill-{uuid.uuid4().hex}-{name}"
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)
    return path


def catalog_row(spark: SparkSession, meta: RollupMeta) -> DataFrame:
    row = (meta.table, ",".join(meta.fns), meta.filter_key, sorted(meta.tags), meta.window, meta.start, meta.end)
    return spark.createDataFrame([row], CATALOG)


def period(window: int, zoned: bool = False) -> Column:
    """The partition of a bucket: its day in UTC, or its year where windows are of a day or more, whatever the session's zone."""
    return F.date_format(moment(to_epoch(F.col("bucket"), zoned=True)) if zoned else F.col("bucket"), "yyyy-MM-dd" if window < 86400 else "yyyy")


def _period_of(epoch: int, window: int) -> str:
    at = datetime(1970, 1, 1) + timedelta(seconds=epoch)
    return at.strftime("%Y-%m-%d" if window < 86400 else "%Y")


# ---- files -------------------------------------------------------------------------------------


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> dict[str, int]:
    """What a folder holds, with the times of change in milliseconds; nothing where it is not."""
    fs, where = _at(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)} if fs.exists(where) else {}


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    found = fs.globStatus(where)
    return found is not None and len(found) > 0


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def _text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that appears in whole or not at all; false where one of this name is there (file systems that rename atomically tell this of two writers at once)."""
    fs, where = _at(spark, path)
    hidden = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    _, staged = _at(spark, hidden)
    stream = fs.create(staged, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    if fs.exists(where) or not fs.rename(staged, where):
        fs.delete(staged, False)
        return False
    return True


# ---- snapshots ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """One state of a stored rollup. ``ledger``: the last number of each source of batches that is in it."""

    version: int
    meta: RollupMeta
    schema: str
    filters: str
    periods: dict[str, list[str]]
    ledger: dict[str, int]
    at: float
    #: Of writes that are clustered: the cut points of each tag, by which their files are dealt to cells.
    layouts: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def json(self) -> str:
        m, used = self.meta, {v for vs in self.periods.values() for v in vs}
        shown = {"table": m.table, "agg_fn": ",".join(m.fns), "filter_key": m.filter_key, "group_keys": sorted(m.tags), "window_s": m.window, "range_start": m.start, "range_end": m.end}
        return json.dumps(shown | {"version": self.version, "meta": json.dumps(asdict(m)), "schema": self.schema, "filters": self.filters, "periods": self.periods, "ledger": self.ledger, "at": self.at, "layouts": {v: c for v, c in self.layouts.items() if v in used}})


def _meta(text: str) -> RollupMeta:
    return RollupMeta(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifest/{version:012d}.json"


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The latest state (or an earlier one that is still kept); None where nothing is stored."""
    if version is None:
        versions = _versions(spark, path)
        if not versions:
            return None
        version = versions[-1]
    d = json.loads(_text(spark, _manifest(path, version)))
    return Snapshot(version, _meta(d["meta"]), d["schema"], d["filters"], d["periods"], d["ledger"], d["at"], d.get("layouts", {}))


def _zoned(df: DataFrame) -> bool:
    return df.schema["bucket"].dataType.typeName() == "timestamp"


def _read(spark: SparkSession, path: str, now: Snapshot, dates=None, where: dict[str, str] | None = None) -> DataFrame:
    """The states of the named periods (all by default). Periods of several writes are merged, the others are read as they lie; of clustered ones only the cells that can hold ``where``."""
    schema = T.StructType.fromJson(json.loads(now.schema))
    wanted = {d: vs for d, vs in now.periods.items() if dates is None or d in dates}
    groups: dict[tuple[bool, str], list[str]] = {}
    for d, vs in sorted(wanted.items()):
        for v in vs:
            groups.setdefault((len(vs) > 1, v if v in now.layouts else ""), []).append(f"{path}/data/v={v}/date={d}")
    once, several = [], []
    for (merged, layout), paths in sorted(groups.items()):
        own = ["v", "date", "cell"] if layout else ["v", "date"]
        whole = T.StructType([*schema.fields, *[T.StructField(c, T.IntegerType() if c == "cell" else T.StringType()) for c in own]])
        df = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*paths)
        if layout and where:
            df = df.where(F.col("cell").isin(*_cells_with(now.layouts[layout], where)))
        (several if merged else once).append(df.drop(*own))
    if several:
        once.append(merge_rows(union_parts(*several), now.meta))
    return union_parts(*once) if once else spark.createDataFrame([], schema)


# ---- clustering --------------------------------------------------------------------------------


def _shape_of(cuts: dict[str, list[str]]) -> list[tuple[str, int]]:
    """Tag and bit of each bit of a cell's number, from the lowest: the tags' bits by turns, so that cells that are near in all tags have near numbers."""
    bits = {t: len(c).bit_length() for t, c in cuts.items()}
    return [(t, b) for b in range(max(bits.values(), default=0)) for t in sorted(bits) if b < bits[t]]


def _below(tag: str):
    return lambda c: (c != "") & F.coalesce(c <= F.col(tag), F.lit(False))


def _cell(cuts: dict[str, list[str]]) -> Column:
    """The number of a row's cell."""
    place = {t: F.size(F.filter(F.array(F.lit(""), *[F.lit(c) for c in cs]), _below(t))) for t, cs in cuts.items()}
    out = F.lit(0)
    for k, (t, b) in enumerate(_shape_of(cuts)):
        out = out + F.shiftleft(F.shiftright(place[t], b).bitwiseAND(F.lit(1)), k)
    return out.cast("int")


def _cells_with(cuts: dict[str, list[str]], where: dict[str, str]) -> list[int]:
    """The cells that can hold rows with these values of tags."""
    shape = _shape_of(cuts)
    fixed = {t: bisect_right(cuts[t], str(x)) for t, x in where.items() if t in cuts}
    return [n for n in range(1 << len(shape)) if all((n >> k & 1) == (fixed[t] >> b & 1) for k, (t, b) in enumerate(shape) if t in fixed)]


def cluster(spark: SparkSession, path: str, rows_per_file: int = 1_000_000, sample: int = 20_000) -> dict[str, list[str]]:
    """Rewrites a stored rollup so that a filter on any one tag reads few of its files; tells the cut points.

    The tags' values are cut into as many parts as make files of about ``rows_per_file`` rows in the largest period; a file holds one cell of that grid. The cut points come
    from at most some ``sample`` rows: they decide where rows lie, not what is read. Readers keep what they have; later saves and merges of a period lie beside it unclustered until the next call.
    """
    cuts: dict[str, list[str]] = {}

    def change(old: Snapshot | None) -> Snapshot | None:
        if old is None or not old.meta.tags:
            return None
        df = _read(spark, path, old)
        # one row a period
        largest = df.groupBy(period(old.meta.window, _zoned(df)).alias("date")).count().agg(F.max("count"), F.sum("count")).first()
        bits = max(0, -(-(largest[0] or 0) // rows_per_file) - 1).bit_length()
        tags = sorted(old.meta.tags)
        seen = df.select(*tags).sample(min(1.0, sample / max(1, largest[1] or 0)), seed=1).limit(2 * sample).collect()
        for i, t in enumerate(tags):
            parts, values = 1 << (bits // len(tags) + (i < bits % len(tags))), sorted(str(r[t]) for r in seen if r[t] is not None)
            cuts[t] = sorted({values[len(values) * k // parts] for k in range(1, parts)}) if values else []
            # a number of parts that bits can hold, without empty ones
            cuts[t] = cuts[t][: (1 << (len(cuts[t]) + 1).bit_length() - 1) - 1]
        name, dates = _write(df, path, old.meta, cuts)
        return replace(old, periods={d: [name] for d in dates}, layouts={name: dict(cuts)})

    _commit(spark, path, change)
    vacuum(spark, path)
    return cuts


def _write(df: DataFrame, path: str, meta: RollupMeta, cuts: dict[str, list[str]] | None = None) -> tuple[str, list[str]]:
    """Writes rows as new files and tells the name of the write and its periods. Tasks are cut by size, not by period; files are sorted by series, so that filters on tags skip row groups."""
    name = uuid.uuid4().hex
    dated = df.withColumn("date", period(meta.window, _zoned(df)))
    by = ["date"]
    if cuts is not None:
        dated, by = dated.withColumn("cell", _cell(cuts)), ["date", "cell"]
    order = [*by, *sorted(meta.tags), "bucket"]
    dated.hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*order).write.mode("errorifexists").partitionBy(*by).parquet(f"{path}/data/v={name}")
    # by the folders: where no row is, Spark may drop an observation with the plan
    return name, [n[5:] for n in _names(df.sparkSession, f"{path}/data/v={name}") if n.startswith("date=")]


def _commit(spark: SparkSession, path: str, change: Callable[[Snapshot | None], Snapshot | None]) -> Snapshot | None:
    """Commits ``change(latest)`` as the next version; anew where another writer was faster. None from ``change`` means that nothing is to be done."""
    for _ in range(ATTEMPTS):
        old = snapshot(spark, path)
        made = change(old)
        if made is None:
            return None
        made = replace(made, version=old.version + 1 if old else 1, at=time.time())
        if _publish(spark, _manifest(path, made.version), made.json()):
            return made
    raise Conflict(f"{path} changed {ATTEMPTS} times while it was being saved")


def _replaced(old: RollupMeta, new: RollupMeta) -> tuple[int | None, int | None]:
    """The buckets [low, high) that ``new`` replaces in ``old``: all of its range but for a partial bucket at an edge, which stays as ``old`` has it in whole."""
    _same_shape(old, new)
    if (new.start is not None and old.end is not None and new.start > old.end) or (new.end is not None and old.start is not None and new.end < old.start):
        raise ValueError("between the stored range and the new one is a gap")
    w, low, high = new.window, new.start, new.end
    if low is not None and low % w:
        whole = (old.start is None or old.start <= low // w * w) and (old.end is None or old.end >= low // w * w + w)
        if not whole and (old.start is None or old.start < low):
            raise ValueError(f"the bucket of the start {low} is partial, here and in the store")
        low = low // w * w + (w if whole else 0)
    if high is not None and high % w:
        whole = (old.end is None or old.end >= high // w * w + w) and (old.start is None or old.start <= high // w * w)
        if not whole and (old.end is None or old.end > high):
            raise ValueError(f"the bucket of the end {high} is partial, here and in the store")
        high = high // w * w + (0 if whole else w)
    return low, high


def _same_shape(old: RollupMeta, new: RollupMeta) -> None:
    shape = lambda m: [m.table, m.window, sorted(m.tags), m.fns, m.fields, m.filter_key]
    if shape(old) != shape(new):
        raise ValueError("the stored rollup is of another shape")


def _hull(old: RollupMeta, new: RollupMeta) -> RollupMeta:
    least = lambda x, y, f: None if x is None or y is None else f(x, y)
    return replace(new, start=least(old.start, new.start, min), end=least(old.end, new.end, max))


def _first(df: DataFrame, rollup: Rollup, meta: RollupMeta, periods: dict, ledger: dict) -> Snapshot:
    return Snapshot(0, meta, df.schema.json(), json.dumps([f.document() for f in rollup.filters]), periods, ledger, 0.0)


def save_rollup(rollup: Rollup, path: str) -> Snapshot:
    """Stores a rollup; what is stored already is kept outside its range and replaced inside.

    Only the periods (days or years, see ``period``) that the range touches are written. In these the stored buckets outside the range
    are merged in. The stored range becomes the hull of both, which must touch. A bucket that is partial at an edge of
    the new range stays as stored if the store has it in whole. ``rollup`` may be one that was loaded from ``path`` and extended.
    A save that dies before its commit leaves the old state; one that finds another committed meanwhile starts anew.
    """
    spark = rollup.df.sparkSession

    def change(old: Snapshot | None) -> Snapshot:
        df, meta = rollup.df, rollup.meta
        if old is None:
            name, dates = _write(df, path, meta)
            return _first(df, rollup, meta, {d: [name] for d in dates}, {})
        low, high = _replaced(old.meta, meta)
        df = df.where(in_range("bucket", low, high, zoned=_zoned(df)))
        first, last = [None if x is None else _period_of(x, meta.window) for x in (meta.start, meta.end)]
        touched = {d for d in old.periods if (first is None or d >= first) and (last is None or d <= last)}
        outside = F.lit(False)
        if low is not None:
            outside = outside | in_range("bucket", None, low, zoned=_zoned(df))
        if high is not None:
            outside = outside | in_range("bucket", high, None, zoned=_zoned(df))
        if touched and (low is not None or high is not None):
            df = df.unionByName(_read(spark, path, old, touched).where(outside))
        name, dates = _write(df, path, meta)
        return replace(old, meta=_hull(old.meta, meta), periods={d: vs for d, vs in old.periods.items() if d not in touched} | {d: [name] for d in dates})

    done = _commit(spark, path, change)
    vacuum(spark, path)
    return done


def merge_rollup(delta: Rollup, path: str, source: str, number: int = 0) -> bool:
    """Merges the states of new points into a stored rollup, writing only the periods they touch; creates it where nothing is stored.

    ``number`` counts the batches of ``source``: one that is not above the stored number is in the rollup already, changes nothing and gives false.
    States and number are committed together, so a batch that is replayed after a crash counts once. ``delta`` must have the stored shape and, at its edges, only
    points of the stored range.
    """
    spark = delta.df.sparkSession

    def change(old: Snapshot | None) -> Snapshot | None:
        if old is not None and old.ledger.get(source, -1) >= number:
            return None
        if old is not None:
            _same_shape(old.meta, delta.meta)
        name, dates = _write(delta.df, path, delta.meta)
        if old is None:
            return _first(delta.df, delta, delta.meta, {d: [name] for d in dates}, {source: number})
        return replace(old, periods=old.periods | {d: [*old.periods.get(d, []), name] for d in dates}, ledger=old.ledger | {source: number})

    done = _commit(spark, path, change)
    if done is not None and any(len(vs) > WRITES for vs in done.periods.values()):
        compact(spark, path, WRITES)
    return done is not None


def compact(spark: SparkSession, path: str, more_than: int = 1) -> bool:
    """Folds periods of more than so many writes into one write each. Readers keep what they have; false where there is nothing to do."""

    def change(old: Snapshot | None) -> Snapshot | None:
        many = {d for d, vs in (old.periods if old else {}).items() if len(vs) > more_than}
        if not many:
            return None
        name, dates = _write(_read(spark, path, old, many), path, old.meta)
        return replace(old, periods={d: vs for d, vs in old.periods.items() if d not in many} | {d: [name] for d in dates})

    done = _commit(spark, path, change) is not None
    vacuum(spark, path)
    return done


def vacuum(spark: SparkSession, path: str, keep: float = KEEP) -> int:
    """Deletes manifests superseded for over ``keep`` seconds, and files that no other names and that are as old; tells how many writes or periods of writes went."""
    before = time.time() - keep
    kept = [snapshot(spark, path, v) for v in _versions(spark, path)]
    gone = [s for s, then in zip(kept, kept[1:], strict=False) if then.at < before]
    kept = kept[len(gone) :]
    for s in gone:
        _delete(spark, _manifest(path, s.version))
    named = {(v, d) for s in kept for d, vs in s.periods.items() for v in vs}
    n = 0
    for folder, changed in _names(spark, f"{path}/data").items():
        if changed >= before * 1000:
            continue
        dates = {d[5:] for d in _names(spark, f"{path}/data/{folder}") if d.startswith("date=")}
        dead = {d for d in dates if (folder[2:], d) not in named}
        for d in dead if dead != dates else ():
            _delete(spark, f"{path}/data/{folder}/date={d}")
        if dead == dates:
            _delete(spark, f"{path}/data/{folder}")
        n += len(dead) or not dates
    return n


def load_rollup(spark: SparkSession, path: str, mt: MetricTable, filters=(), start: int | None = None, end: int | None = None, version: int | None = None, where: dict[str, str] | None = None) -> Rollup:
    """A stored rollup as of now (or of a kept ``version``); it keeps reading these files when others save. With ``start`` and ``end`` only the periods of that range are listed and read, with ``where`` (values of tags) only
    rows that have these, from the files that can hold them."""
    now = snapshot(spark, path, version)
    if now is None:
        raise FileNotFoundError(f"no rollup is stored in {path}")
    filters = tuple(filters) or tuple(filter_from(f) for f in json.loads(now.filters))
    low, high = [None if x is None else _period_of(x, now.meta.window) for x in (None if start is None else start - now.meta.window, end)]
    dates = {d for d in now.periods if (low is None or d >= low) and (high is None or d <= high)}
    df = _read(spark, path, now, dates, where)
    for t, x in (where or {}).items():
        df = df.where(F.col(t) == F.lit(str(x)))
    return Rollup(df, mt, now.meta, filters)


# ---- a folder of several rollups ------------------------------------------------------------------


def place(root: str, meta: RollupMeta) -> str:
    """The folder of a rollup below ``root``: by table, functions, filters, tags, fields and window, not by range."""
    key = json.dumps([meta.table, sorted(meta.fns), meta.filter_key, sorted(meta.tags), sorted(meta.fields), meta.window])
    return f"{root}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per rollup below ``root`` with its ``path``; none where nothing is stored."""
    kinds = f"{CATALOG}, meta string, filters string, version bigint"
    if not _exists(spark, f"{root}/*/manifest/*.json"):
        return spark.createDataFrame([], f"{kinds}, path string")
    rows = spark.read.schema(kinds).json(f"{root}/*/manifest/[0-9]*.json")
    rows = rows.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), "/manifest/[^/]*$", ""))
    return rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "version").alias("r")).select("r.*", "path")


def find_rollups(spark: SparkSession, root: str, table: str, filter_key: str | None = None) -> list[tuple[str, RollupMeta, tuple]]:
    """Path, metadata and filters of the stored rollups of a table (and filter set): as many as were stored for it, whatever the data."""
    rows = catalog(spark, root).where(F.col("table") == table)
    rows = rows if filter_key is None else rows.where(F.col("filter_key") == filter_key)
    return [(r.path, _meta(r.meta), tuple(filter_from(f) for f in json.loads(r.filters))) for r in rows.select("path", "meta", "filters").collect()]


def clear(spark: SparkSession, root: str) -> None:
    """Forgets all rollups below ``root``."""
    _delete(spark, root)
