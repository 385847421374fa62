"""Near-dedup of embeddings by randomised-rotation binary codes.

A unit vector is padded with zeros and rotated at random; its code is the signs of the result, and with it
goes the correction factor <code, vector>. Divided by the factor, a code's inner product with another rotated
vector is an unbiased estimate of the vectors' own, with an error bound that holds but for a chance set by ``SIGMAS``.

Bands of bits of such codes route vectors to keys: near vectors agree in most bits, so over enough bands they
meet under some key but for a chance of at most ``MISS`` (measured recall: see the README). Bands get wider and more as
the table grows, so that unrelated vectors under a key stay few. Under a key a pair
is estimated from the codes; only where estimate plus bound reach the limit the exact cosine is
computed, in double precision, and decides. A pair that met in an earlier band is left to that band, so every pair counts once.

Equal vectors are one vector with a count. A key with many vectors is cut into blocks, and pairs of blocks
are tasks of their own; of links only counts and a spanning forest leave a task.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, materialize
from .components import connected_components
from .simhash import Forest

LIMIT = 0.93
#: Code length at least; vectors are padded up to it.
CODE_BITS = 256
#: Bits of a band at least; from there on so many that about ``STRAYS`` unrelated vectors meet under a key.
BAND, STRAYS = 12, 16
#: Chance that a pair whose cosine is the limit itself meets in no band.
MISS = 0.002
#: Width of the error bound, in standard deviations of the estimate.
SIGMAS = 5.0
#: Vectors under one key that one task compares; more are cut into blocks.
BLOCK = 1024
#: Keys with at most this many vectors are compared together.
SMALL = 24


@functools.lru_cache(maxsize=64)
def rotation(dim: int, bits: int = CODE_BITS, seed: int = 42) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix: zero padding needs no others."""
    size = max(bits, dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (-1, 1) and correction factors of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    signs = np.where(turned >= 0, 1.0, -1.0)
    return signs, (np.abs(turned)).sum(axis=1) / math.sqrt(turned.shape[1])


def estimates(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors (rows) with rotated ones (columns), and each row's bound."""
    bits = signs.shape[1]
    bound = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * SIGMAS / math.sqrt(bits - 1)
    return signs @ turned.T / math.sqrt(bits) / factor[:, None], bound[:, None]


def bands(n: int, limit: float = LIMIT) -> tuple[int, int]:
    """Number and width of the bands for ``n`` vectors that are compared with each other.

    A code bit of two vectors agrees with a chance of 1 - angle / pi.
    """
    width = max(BAND, math.ceil(math.log2(max(1, n) / STRAYS)))
    agree = 1 - math.acos(min(1.0, max(-1.0, limit))) / math.pi
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(agree**width)))) if agree < 1 else 1, width


def _band_keys(unit: np.ndarray, tables: int, width: int) -> np.ndarray:
    """Keys of the bands, row by row; no two bands share a bit, a further rotation gives bits where a code's are used up."""
    out, bit = [], np.int64(1) << np.arange(width, dtype=np.int64)
    for seed in range(42, 42 + tables):
        turned = unit @ rotation(unit.shape[1], seed=seed)
        use = min(tables - sum(o.shape[1] for o in out), turned.shape[1] // width)
        out.append((turned[:, : use * width] >= 0).reshape(len(unit), use, width) @ bit)
        if sum(o.shape[1] for o in out) == tables:
            break
    return np.concatenate(out, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to 0.5 .. 1: exact, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(batches, tables: int, width: int):
    """``vector number, band, key`` for every vector and band."""
    for batch in batches:
        if batch.num_rows:
            keys = _band_keys(_unit(_scaled(_matrix(batch.column(1)))), tables, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], names=["v", "keys"])


class _Side:
    """Vectors with all that comparing them takes: numbers, counts, raw and rotated values, signs, factors, bands' keys."""

    def __init__(self, table: pa.Table | None = None, shape: tuple[int, int] | None = None, parts: tuple | None = None):
        if parts is None:
            self.x = _scaled(_matrix(table.column("vec").combine_chunks()))
            unit = _unit(self.x)
            self.signs, self.factor = codes(unit)
            self.turned = unit @ rotation(unit.shape[1])
            self.keys = _band_keys(unit, *shape)
            self.v, self.n = table.column("v").to_numpy(), table.column("n").to_numpy()
        else:
            self.x, self.signs, self.factor, self.turned, self.keys, self.v, self.n = parts

    def take(self, rows) -> _Side:
        return _Side(parts=tuple(c[rows] for c in (self.x, self.signs, self.factor, self.turned, self.keys, self.v, self.n)))

    def __len__(self) -> int:
        return len(self.v)


def _decide(left: _Side, right: _Side, i: np.ndarray, j: np.ndarray, band, limit: float) -> np.ndarray:
    """Which of the pairs are links that no earlier band has met."""
    earlier = np.arange(left.keys.shape[1]) < np.broadcast_to(np.asarray(band), i.shape)[:, None]
    keep = np.flatnonzero(~((left.keys[i] == right.keys[j]) & earlier).any(axis=1))
    x, y = left.x[i[keep]], right.x[j[keep]]
    exact = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
    return keep[exact >= limit]


class _Found:
    """Counts and forest edges of rows 0 .. len - 1 of a side, or of two one after the other."""

    def __init__(self, v: np.ndarray, n: np.ndarray):
        self.v, self.n, self.sums, self.forest, self.edges = v, n, np.zeros(len(v), np.int64), Forest(len(v)), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.sums, a, self.n[b])
        np.add.at(self.sums, b, self.n[a])
        used = self.forest.join(a, b)
        self.edges.append((self.v[a[used]], self.v[b[used]]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = self.sums > 0
        a = np.concatenate([e[0] for e in self.edges]) if self.edges else np.zeros(0, np.int64)
        b = np.concatenate([e[1] for e in self.edges]) if self.edges else np.zeros(0, np.int64)
        return np.concatenate((self.v[has], a)), np.concatenate((self.sums[has], np.zeros(len(a), np.int64))), np.concatenate((np.full(has.sum(), -1), b))


def _compare(left: _Side, right: _Side | None, band: int, limit: float):
    """All pairs within ``left``, or between ``left`` and ``right``, by blocks of estimates."""
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    found = _Found(left.v, left.n) if right is None else _Found(np.concatenate((left.v, right.v)), np.concatenate((left.n, right.n)))
    step = max(1, (1 << 21) // max(1, len(other)))
    for at in range(0, len(left), step):
        est, bound = estimates(left.signs[at : at + step], left.factor[at : at + step], other.turned)
        i, j = np.nonzero(est + bound >= limit)
        i += at
        if right is None:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 15):
            a, b = i[part : part + (1 << 15)], j[part : part + (1 << 15)]
            links = _decide(left, other, a, b, band, limit)
            found.add(a[links], b[links] + shift)
    return found.rows()


def _compare_small(side: _Side, task: np.ndarray, band: np.ndarray, run: np.ndarray, limit: float):
    """All pairs within runs of few rows, for all such runs at once: rows at distance 1, then 2, and so on."""
    found, bits = _Found(side.v, side.n), side.signs.shape[1]
    bound = np.sqrt(np.maximum(0, 1 - side.factor**2)) / side.factor * SIGMAS / math.sqrt(bits - 1)
    for d in range(1, SMALL):
        a = np.flatnonzero((task[:-d] == task[d:]) & (run[:-d] <= SMALL)) if d < len(task) else np.zeros(0, np.int64)
        if not len(a):
            break
        est = np.einsum("ij,ij->i", side.signs[a], side.turned[a + d]) / math.sqrt(bits) / side.factor[a]
        a = a[est + bound[a] >= limit]
        links = _decide(side, side, a, a + d, band[a], limit)
        found.add(a[links], a[links] + d)
    return found.rows()


def _tasks(batches, limit: float, shape: tuple[int, int]):
    """Rows arrive in runs of a task, which is a key or a pair of blocks of one; yields counts (w = -1) and edges."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table):
        task, side, band = (table.column(c).to_numpy() for c in ("task", "side", "band"))
        starts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1))
        size = np.diff(np.append(starts, len(task)))
        dims = np.diff(table.column("vec").combine_chunks().offsets.to_numpy())
        # runs of one row, and those whose both sides are large, aside
        small = np.repeat((size > 1) & (size <= SMALL) & (np.maximum.reduceat(side, starts) == 0), size)
        run = np.repeat(size, size)
        out = []
        for d in np.unique(dims[small]):
            rows = np.flatnonzero(small & (dims == d))
            out.append(_compare_small(_Side(table.take(pa.array(rows)), shape), task[rows], band[rows], run[rows], limit))
        for k in np.flatnonzero((size > 1) & ~small[starts]):
            part = slice(starts[k], starts[k] + size[k])
            own = _Side(table.slice(starts[k], size[k]), shape)
            two = side[part] == 1
            out.append(_compare(own.take(~two), own.take(two) if two.any() else None, int(band[starts[k]]), limit))
        made = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=["v", "links", "w"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 4 * BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            task = table.column("task").to_numpy()
            cut = int(np.flatnonzero(task != task[-1])[-1]) + 1 if (task != task[-1]).any() else 0
            if cut:
                yield solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def embedding_groups(vectors: DataFrame, limit: float = LIMIT, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """Per row ``vec_id, n_links, component_id, kept``; only vectors of equal labels and dimensions are compared.

    Null labels, null or zero vectors and vectors with null or non-finite components link with nothing; an empty table gives none.
    Components may be of any finite size.
    Repeated rows link with each other like any equal vectors. A null id can be linked but never names a component unless alone.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("raw"))
    fine = F.col("label").isNotNull() & F.col("raw").isNotNull() & F.coalesce(F.size("raw") > 0, F.lit(False))
    fine = fine & F.coalesce(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("raw", lambda x: x != 0), F.lit(False))
    # floats travel as such and are doubles in the tasks alone
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = rows.withColumn("good", fine).withColumn("vec", F.when(F.col("good"), F.col("raw").cast(f"array<{kind}>"))).drop("raw")
    # vectors that hold the same numbers once; -0.0 counts as 0.0
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)))
    h = [F.xxhash64("label", "vec"), F.hash("vec", "label")]
    keyed = materialize(rows.withColumn("h1", F.when(F.col("good"), h[0])).withColumn("h2", F.when(F.col("good"), h[1])), "vectors")
    good = keyed.where("good").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    good = materialize(good.withColumn("v", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "classes")
    largest = good.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    shape = bands(largest, limit)
    banded = good.select("v", "vec").mapInArrow(_uniform(lambda it: _keys(it, *shape)), "v long, keys array<long>")
    keys = banded.join(good.select("v", "label", "dim"), "v").select("v", "label", "dim", F.posexplode("keys").alias("band", "key"))
    keys = materialize(keys, "keys")
    group = ["label", "dim", "band", "key"]
    sizes = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("rows") / block).cast("int"))
    at = F.pmod(F.xxhash64("v", F.lit("block")), F.col("blocks")).cast("int")
    placed = keys.join(sizes, group).withColumn("b", at)
    # pairs (i, j) of blocks with i <= j: a vector of block b goes to (b, j) for j >= b and, on the other side, to (i, b) for i < b
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j"), F.when(x >= F.col("b"), 0).otherwise(1).cast("long").alias("side")))
    placed = placed.select("v", *group, F.explode(pairs).alias("t"))
    placed = placed.withColumn("task", F.xxhash64(*group, "t.i", "t.j", F.lit("task"))).select("v", "task", F.col("band").cast("long").alias("band"), "t.side")
    full = placed.join(good.select("v", "n", "vec"), "v")
    parts = full.repartition("task").sortWithinPartitions("task").select("task", "band", "side", "v", "n", "vec")
    found = materialize(parts.mapInArrow(lambda it: _tasks(it, limit, shape), "v long, links long, w long"), "links")
    counts = found.where("w < 0").groupBy("v").agg(F.sum("links").alias("links"))
    edges = found.where("w >= 0").select(F.col("v").alias("a"), F.col("w").alias("b")).distinct()
    linked = connected_components(edges)
    named = good.select("v", "h1", "h2", "n", "least").join(counts, "v", "left").join(linked.withColumnRenamed("node", "v"), "v", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "v")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # a vector that many rows hold is joined in parts
    out = keyed_join(keyed.where("good").select("vec_id", "h1", "h2"), materialize(named, "answers"), ["h1", "h2"], "n", ("vec_id",)).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.unionByName(keyed.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _uniform(work):
    """Splits batches so that all vectors of one have the same dimension."""

    def run(batches):
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(dims):
                yield from work([batch.take(pa.array(np.flatnonzero(dims == d)))])

    return run
