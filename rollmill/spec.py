"""What a caller declares: metric tables, filter trees, queries and rollups."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the units a duration may have.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
#: Aggregate functions; all but medians have states that merge. ``approx_median`` is off by a ten-thousandth of a group's values at most, and keeps no more of them than a sketch.
FUNCTIONS = ("mean", "sum", "min", "max", "count", "median", "approx_median", "first", "last")
UNMERGED = ("median", "approx_median")


def seconds(duration: str | int) -> int:
    """``"10m"`` -> 600. An unknown unit is an error."""
    if isinstance(duration, int):
        return duration
    m = re.fullmatch(r"(\d+)([a-z])", duration)
    if not m or m[2] not in UNITS:
        raise ValueError(f"not a duration: {duration!r}; units are {', '.join(UNITS)}")
    return int(m[1]) * UNITS[m[2]]


@dataclass(frozen=True)
class MetricTable:
    """A table of points: a time, string tags, float fields and columns that settle ties in time.

    ``places`` declares that the fields are decimal numbers with so many places, below 10^(18 - places): their sums and means are then
    exact, so that they do not depend on the order of adding. Values that are no such numbers (more places, NaN, infinities) are errors.
    """

    name: str
    time: str
    tags: tuple[str, ...]
    fields: tuple[str, ...]
    ties: tuple[str, ...] = ()
    places: int | None = None

    def check(self, df: DataFrame) -> DataFrame:
        missing = [c for c in (self.time, *self.tags, *self.fields, *self.ties) if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} has no column {', '.join(missing)}")
        kind = df.schema[self.time].dataType.typeName()
        if not kind.startswith("timestamp"):
            raise ValueError(f"{self.name}.{self.time} is {kind}, not a timestamp")
        return df

    def chosen(self, fields) -> list[str]:
        """``["*"]`` means all fields."""
        fields = list(self.fields) if list(fields) == ["*"] else list(fields)
        if unknown := [f for f in fields if f not in self.fields]:
            raise ValueError(f"{self.name} has no field {', '.join(unknown)}")
        return fields


# ---- filters -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Eq:
    """A tag equals a value; values are compared as strings."""

    key: str
    value: str

    def column(self) -> Column:
        return F.col(self.key) == F.lit(str(self.value))

    def canonical(self) -> str:
        return f"{self.key}={self.value}"

    def document(self) -> dict:
        return {"type": "raw", "key": self.key, "value": self.value}


@dataclass(frozen=True)
class _Tree:
    nodes: tuple

    def __init__(self, *nodes):
        object.__setattr__(self, "nodes", tuple(nodes))

    def canonical(self) -> str:
        return f"{self.kind}({','.join(sorted(n.canonical() for n in self.nodes))})"

    def document(self) -> dict:
        return {"type": self.kind, "filter": [n.document() for n in self.nodes]}


@dataclass(frozen=True, init=False)
class Or(_Tree):
    """Any of its nodes. Leaves of one tag become an IN, which readers can push down."""

    kind = "or"

    def column(self) -> Column:
        leaves = [n for n in self.nodes if isinstance(n, Eq)]
        if leaves and len(leaves) == len(self.nodes) and len({n.key for n in leaves}) == 1:
            return F.col(leaves[0].key).isin(*[str(n.value) for n in leaves])
        return reduce(or_, [n.column() for n in self.nodes])


@dataclass(frozen=True, init=False)
class And(_Tree):
    """All of its nodes."""

    kind = "and"

    def column(self) -> Column:
        return reduce(and_, [n.column() for n in self.nodes])


def filter_from(doc: dict):
    """A filter tree from its document; a node without a type is a leaf."""
    kind = doc.get("type") or "raw"
    if kind == "raw":
        return Eq(doc["key"], doc["value"])
    nodes = [filter_from(x) for x in doc["filter"]]
    if kind not in ("or", "and"):
        raise ValueError(f"not a filter type: {kind!r}")
    return Or(*nodes) if kind == "or" else And(*nodes)


def fingerprint(filters) -> str:
    """A key that does not depend on the order of filters or of their leaves."""
    return "&".join(sorted(f.canonical() for f in filters))


# ---- queries and rollups ----------------------------------------------------------------------


def resolve_relative(fr: str, to: str | None, now: int) -> tuple[int, int]:
    """``now - fr`` to ``now - to`` (or now), in epoch seconds; ``now`` is an argument so that reruns agree."""
    return now - seconds(fr), now - (seconds(to) if to else 0)


@dataclass(frozen=True)
class MetricQuery:
    table: str
    fields: tuple[str, ...]
    fn: str | None
    window: int | None
    tags: tuple[str, ...] = ()
    filters: tuple = ()
    start: int | None = None
    end: int | None = None
    relative: tuple[str, str | None] | None = None
    create_empty: bool = False

    def __post_init__(self):
        if self.fn is not None and self.fn not in FUNCTIONS:
            raise ValueError(f"not an aggregate: {self.fn!r}; known: {', '.join(FUNCTIONS)}")

    @classmethod
    def from_json(cls, doc: str | dict) -> MetricQuery:
        d = json.loads(doc) if isinstance(doc, str) else doc
        agg, rng, rel = d.get("aggregate") or {}, d.get("range") or {}, d.get("relativeRange") or {}
        return cls(
            table=d["table"], fields=tuple(d["measurements"]), fn=agg.get("aggFunc"), window=seconds(agg["timeWindow"]) if agg else None,
            tags=tuple(d.get("groupKeys") or ()), filters=tuple(filter_from(f) for f in d.get("filters") or ()),
            start=rng.get("start"), end=rng.get("end"), relative=(rel["fr"], rel.get("to")) if rel else None, create_empty=bool(agg.get("createEmpty")),
        )

    def at(self, now: int | None) -> MetricQuery:
        """With an absolute range; a missing end is filled with ``now``."""
        if self.relative:
            start, end = resolve_relative(*self.relative, now)
            return replace(self, start=start, end=end, relative=None)
        return replace(self, end=now) if self.end is None and now is not None else self


@dataclass(frozen=True)
class RollupMeta:
    """One row of a catalog of rollups."""

    table: str
    window: int
    tags: tuple[str, ...]
    fns: tuple[str, ...]
    fields: tuple[str, ...]
    filter_key: str = ""
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class Rollup:
    """Buckets with mergeable states, and what they describe."""

    df: DataFrame
    mt: MetricTable
    meta: RollupMeta
    filters: tuple = field(default=())
