"""SimHash fingerprints and near-duplicate groups.

Fingerprints within ``k`` bits share at least one of ``k + 1`` bit blocks, so they are
routed by block (with a block's value as key) and only compared under an equal key. Under
a key, a hierarchical index in Gray order does the comparing: fingerprints are sorted by their
rank in the Gray code, neighbours are grouped bottom-up, and each node keeps the
bits all its members share (a mask and a pattern). Two nodes differ at least in the shared
bits in which their patterns differ; where these exceed ``k`` the whole groups are pruned,
and where even all unshared bits leave at most ``k`` they are linked as a whole. What
comes out is a spanning forest of the links, never all pairs.

A key under which too many different fingerprints lie is split by blocks of the bits
that the key does not cover, again without losing a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_join, materialize
from .components import connected_components

BITS = 64
#: Different fingerprints under one key that one task indexes.
MAX_KEY = 20_000
FAN = 8


def fingerprint(text: str | None, n: int = 3) -> int:
    """Bit is 1 if it is set in over half of the hashes of the ``n``-word shingles, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > n:
        a, b = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    else:
        a, b = [0], [len(joined)]
    digest = xxhash.xxh64_digest
    rows = np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in zip(a, b, strict=True)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 255 * 64):  # sums of 255 rows fit a byte
        bits = np.unpackbits(rows[at : at + 255 * 64], axis=1)
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints, schema)


# ---- the index under one key -------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray code."""
    r = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Forest:
    """Union-find over 0 .. n-1 by arrays; joins in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root[x]
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins the pairs; says which pairs were needed."""
        needed = np.zeros(len(a), bool)
        todo = np.arange(len(a))
        while len(todo):
            x, y = self.find(a[todo]), self.find(b[todo])
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            todo = todo[hi != lo]
            hi, lo = hi[hi != lo], lo[hi != lo]
            top, first = np.unique(hi, return_index=True)
            self.root[top] = lo[first]
            needed[todo[first]] = True
        return needed


def gray_links(keys: np.ndarray, fps: np.ndarray, k: int = 3, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect, under each key, all fingerprints that links of at most ``k`` bits connect."""
    n = len(fps)
    order = np.lexsort((gray_rank(fps), keys))
    key, leaf = keys[order], fps[order].astype(np.uint64)
    # levels bottom-up: all-ones, all-zeros and the first leaf of every node; a node never spans two keys
    ands, ors, firsts, lasts, kids = [leaf], [leaf], [np.arange(n)], [np.arange(n) + 1], [None]
    level_key = key
    while True:
        new = np.concatenate(([True], level_key[1:] != level_key[:-1])) if len(level_key) else np.zeros(0, bool)
        if new.all():
            break
        run = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        starts = np.flatnonzero(run % FAN == 0)
        ands.append(np.bitwise_and.reduceat(ands[-1], starts))
        ors.append(np.bitwise_or.reduceat(ors[-1], starts))
        ends = np.append(starts[1:], len(new))
        firsts.append(firsts[-1][starts])
        lasts.append(lasts[-1][ends - 1])
        kids.append((starts, ends))
        level_key = level_key[starts]
    forest, out_a, out_b = Forest(n), [], []

    def link(a, b):
        used = forest.join(a, b)
        out_a.append(a[used])
        out_b.append(b[used])

    def whole(level, nodes):
        """Chains all leaves of each node."""
        size = lasts[level][nodes] - firsts[level][nodes]
        at = np.repeat(firsts[level][nodes], size - 1) + (np.arange((size - 1).sum()) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1))
        link(at, at + 1)

    def one(level, nodes):
        """Whether all leaves of a node are in one component, as far as its ends tell for leaves in a row."""
        if level == 0:
            return np.ones(len(nodes), bool)
        roots = forest.find(np.arange(n))
        brk = np.concatenate(([0], np.cumsum(roots[1:] != roots[:-1])))
        return brk[firsts[level][nodes]] == brk[lasts[level][nodes] - 1]

    top = len(ands) - 1
    stack = [(top, np.arange(len(ands[top])), np.arange(len(ands[top])))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        A, O, A2, O2 = ands[level][a], ors[level][a], ands[level][b], ors[level][b]
        apart = np.bitwise_count((A & ~O2) | (A2 & ~O))  # bits that differ between any two members
        near = apart <= k
        if level == 0:
            near &= a != b
            link(a[near], b[near])
            continue
        a, b, most = a[near], b[near], np.bitwise_count((O | O2) & ~(A & A2))[near]
        tight = most <= k  # any two members of both are near
        if tight.any():
            both = np.unique(np.concatenate((a[tight], b[tight])))
            whole(level, both)
            link(firsts[level][a[tight]], firsts[level][b[tight]])
        a, b = a[~tight], b[~tight]
        if len(a):  # nodes that hang together already need no look inside
            done = one(level, a) & one(level, b) & (forest.find(firsts[level][a]) == forest.find(firsts[level][b]))
            a, b = a[~done], b[~done]
        if len(a):
            starts, ends = kids[level]
            na, nb = ends[a] - starts[a], ends[b] - starts[b]
            pairs = na * nb
            which = np.repeat(np.arange(len(a)), pairs)
            inner = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x, y = starts[a][which] + inner // nb[which], starts[b][which] + inner % nb[which]
            keep = (a[which] != b[which]) | (x <= y)
            stack.append((level - 1, x[keep], y[keep]))
    a = np.concatenate(out_a) if out_a else np.zeros(0, int)
    b = np.concatenate(out_b) if out_b else np.zeros(0, int)
    return order[a], order[b]


# ---- over the cluster ----------------------------------------------------------------------


def _masks(bits: list[int], parts: int) -> list[int]:
    """The given bit positions in ``parts`` blocks, as masks."""
    blocks = np.array_split(np.array(bits), parts)
    return [int(sum(1 << int(b) for b in block)) for block in blocks if len(block)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _route(fps: DataFrame, k: int, max_key: int) -> DataFrame:
    """``(mask, value, fp)``: every two fingerprints within ``k`` bits meet under some mask and value.

    Keys with more than ``max_key`` fingerprints are split by further blocks until none is, or until
    the key covers so many bits that its fingerprints are few.
    """
    spread = lambda df, masks: df.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    rows = spread(fps, _masks(list(range(BITS)), k + 1)).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    settled = None
    for _ in range(4):
        heavy = materialize(rows.groupBy("mask", "value").count().where(F.col("count") > max_key).drop("count"), "heavy")
        masks = [r.mask for r in heavy.select("mask").distinct().collect()]  # at most some hundred masks, whatever the data
        if not masks:
            break
        light = rows.join(heavy, ["mask", "value"], "left_anti")
        settled = light if settled is None else settled.unionByName(light)
        split = None
        for m in masks:
            free = [b for b in range(BITS) if not (m >> b) & 1]
            inner = [_signed((m & (1 << 64) - 1) | x) for x in _masks(free, k + 1)]
            part = rows.where(F.col("mask") == m).join(heavy, ["mask", "value"], "left_semi").select("fp", F.explode(F.array(*map(F.lit, inner))).alias("mask"))
            split = part if split is None else split.unionByName(part)
        rows = materialize(split.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "split")
    return rows if settled is None else settled.unionByName(rows)


def _links(batches, k):
    """Runs of equal keys arrive together; a batch is cut at the last key's start."""
    held = None
    blocks = []

    def work(table):
        mask, value, fp = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        _, keys = np.unique(np.stack((mask, value), axis=1), axis=0, return_inverse=True)
        a, b = gray_links(keys.ravel(), fp.view(np.uint64), k)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    for batch in batches:
        blocks.append(batch)
        if sum(b.num_rows for b in blocks) < 200_000:
            continue
        held = pa.Table.from_batches(blocks)
        mask, value = held.column(0).to_numpy(), held.column(1).to_numpy()
        other = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from work(held.slice(0, cut))
            blocks = held.slice(cut).to_batches()
    if blocks:
        yield from work(pa.Table.from_batches(blocks))


def near_groups(fps: DataFrame, k: int = 3, max_key: int = MAX_KEY) -> DataFrame:
    """``(fp, root)`` for the fingerprints that have a link; ``fps`` holds different values of ``fp``."""
    routed = _route(fps, k, max_key)
    # of a key with one fingerprint nothing comes; the sort keeps keys in runs
    runs = routed.repartition("mask", "value").sortWithinPartitions("mask", "value").select("mask", "value", "fp")
    edges = materialize(runs.mapInArrow(lambda it: _links(it, k), "a long, b long").distinct(), "edges")
    return connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def classes(rows: DataFrame, k: int = 3, max_key: int = MAX_KEY) -> DataFrame:
    """``(fp, root)`` for every fingerprint among ``rows``: equal root, same group."""
    fps = materialize(rows.select("fp").distinct(), "fps")
    linked = near_groups(fps, k, max_key)
    return materialize(fps.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_key: int = MAX_KEY) -> DataFrame:
    """Per document ``doc_id, fingerprint (16 hex digits), component_id``.

    Documents are linked where their fingerprints differ in at most ``k`` bits; component_id is the
    smallest doc_id that links reach. Null and blank texts have fingerprint 0 and are
    linked like any other, texts may be of any length. A null doc_id takes part, counting as greater than any id (null where alone). Repeated rows stay repeated. Other columns are ignored; an empty table gives none.
    """
    rows = materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints")
    # a fingerprint that many rows have is counted before the exchange, and joined back in parts
    per = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "per-fingerprint")
    grouped = materialize(per.join(classes(per, k, max_key), "fp"), "grouped")
    named = grouped.select("fp", "n", "root").join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root")
    out = keyed_join(rows, materialize(named, "named"), ["fp"], "n", ("doc_id",))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
