"""Near copies by similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Min-hash bands route shingle sets: two sets meet under a key if all hashes of one of their bands agree. Under a key the
Gray-order index of ``simhash`` proposes a spanning forest of pairs, which are checked exactly. Where a key then
still holds more than one group, the sets themselves go to tasks of two blocks of the key each, which compare all pairs across
groups and return a spanning forest of the links. So every two sets that meet are in one group or known to be less similar, and pairs are never listed.

Sets of similarity 0.8 miss each other in all bands with a chance of ``(1 - 0.8 ** ROWS) ** BANDS``, 6e-5, more similar ones with less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, with_hash_in
from .components import connected_components

SHINGLE = 5
#: Near copies share at least NUM / DEN of the shingles that either has.
NUM, DEN = 4, 5
BANDS, ROWS = 32, 6
#: Bits in which fingerprints that the index proposes may differ; pairs beyond are left to the second check.
RADIUS = 20
#: Sets, and hashes in them, that one block of a key holds about.
BLOCK, BLOCK_HASHES = 1024, 1_000_000
#: Columns of the matrix in which a task counts what sets have in common, and the pairs that are cheaper to count one by one.
COLUMNS, FEW = 8192, 4096

_FACTORS = (np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's ``n``-word shingles in order; a shorter text is one shingle, no words are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = (starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()) if len(words) > n else ([0], [len(joined)])
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in zip(a, b, strict=True)]), np.uint64))


def sketch(hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """``(node, fp, bands)``: a hash of the whole set, its SimHash fingerprint and a key for each band; equal sets, equal sketches."""
    node = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
    if not len(hashes):
        return node, 0, np.zeros(0, np.uint64)
    ones, least = np.zeros(64, np.int64), np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        np.minimum(least, np.multiply.outer(_FACTORS, part.astype(np.uint32)).min(axis=1), out=least)
    fp = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")
    rows = least.reshape(BANDS, ROWS)
    bands = [xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)]
    return node, fp, np.array(bands, np.uint64)


def _sketches(batches):
    for batch in batches:
        nodes, fps, sizes, bands, ends = [], [], [], [], [0]
        for text in batch.column(batch.num_columns - 1):
            hashes = shingle_hashes(text.as_py())
            node, fp, keys = sketch(hashes)
            nodes.append(node)
            fps.append(fp)
            sizes.append(len(hashes))
            bands.append(keys)
            ends.append(ends[-1] + len(keys))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        flat = signed(np.concatenate(bands) if bands else [])
        added = [signed(nodes), signed(fps), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "node", "fp", "n", "bands"])


def _proposed(batches, radius):
    """Pairs of nodes from runs of equal keys; a batch is cut at the last key's start."""
    blocks = []

    def work(table):
        key, fp, node = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        a, b = simhash.gray_links(np.unique(key, return_inverse=True)[1].ravel(), fp.view(np.uint64), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    for batch in batches:
        blocks.append(batch)
        if sum(b.num_rows for b in blocks) < 200_000:
            continue
        held = pa.Table.from_batches(blocks)
        key = held.column(0).to_numpy()
        other = np.flatnonzero(key != key[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from work(held.slice(0, cut))
            blocks = held.slice(cut).to_batches()
    if blocks:
        yield from work(pa.Table.from_batches(blocks))


def _sets(batches):
    for batch in batches:
        sets = [shingle_hashes(t.as_py()).view(np.int64) for t in batch.column(1)]
        ends = np.cumsum([0, *map(len, sets)])
        flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["node", "hashes"])


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes the sets a[i] and b[i] share."""
    if len(a) <= FEW:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[rows[i:j], column[i:j] - at] = 1
        counts += part @ part.T
    return counts[a, b].astype(np.int64)


def cross_links(sets: list[np.ndarray], roots: np.ndarray, bands: np.ndarray, band: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the near copies among the sets of one key that are in different groups; pairs that an earlier band has met are left to it.

    With two sides only pairs between them are compared.
    """
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1) if not side.any() else (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    keep = (roots[i] != roots[j]) & (NUM * np.maximum(size[i], size[j]) <= DEN * np.minimum(size[i], size[j]))
    i, j = i[keep], j[keep]
    for k in range(band):
        keep = bands[i, k] != bands[j, k]
        i, j = i[keep], j[keep]
    both = _common(sets, i, j)
    near = DEN * both >= NUM * (size[i] + size[j] - both)
    i, j = i[near], j[near]
    used = simhash.Forest(len(sets)).join(i, j)
    return i[used], j[used]


def _across(batches):
    """Rows in runs of a task; yields links between nodes."""
    held: list[pa.RecordBatch] = []

    def solve(table):
        task = table.column("task").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]))
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            part = table.slice(s, e - s).combine_chunks()
            node, root, band, side = (part.column(c).to_numpy() for c in ("node", "root", "band", "side"))
            sets = [x.values.to_numpy() for x in part.column("hashes")]
            bands = np.stack([x.values.to_numpy() for x in part.column("bands")])
            a, b = cross_links(sets, root, bands, int(band[0]), side)
            out_a.append(node[a])
            out_b.append(node[b])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        task = batch.column(batch.schema.get_field_index("task")).to_numpy()
        if len(task) and task[0] != task[-1]:  # a run is whole once the next begins
            table = pa.Table.from_batches(held)
            task = table.column("task").to_numpy()
            cut = int(np.flatnonzero(task != task[-1])[-1]) + 1
            yield solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield solve(pa.Table.from_batches(held))


def _fits(n: Column, m: Column) -> Column:
    """Whether sets of such sizes can be near copies at all."""
    return NUM * F.greatest(n, m) <= DEN * F.least(n, m)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The near copies among ``pairs (a, b)``."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(DEN * common >= NUM * (F.size("x") + F.size("y") - common)).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    groups = connected_components(links).select(F.col("node"), F.col("component").alias("root"))
    return members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, th, node, root)`` per row of ``docs``; th is the text's hash, equal root means same group.

    Documents are linked where their sets are equal (so blank and null texts are one group) or at least 0.8 similar.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"), F.col(text_col).alias("__text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, node long, fp long, n long, bands array<long>"
    sketches = materialize(rows.mapInArrow(_sketches, schema), "sketches")
    first = F.min(F.struct("th", F.col("doc_id").isNull().alias("z"), "doc_id")).alias("first")
    nodes = sketches.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), first)
    nodes = materialize(nodes, "nodes")
    met = nodes.select(F.posexplode("bands").alias("band", "key"), "fp", "node", "n")
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = materialize(met.join(shared, "key"), "met")  # of a key with one set nothing comes
    runs = met.select("key", "fp", "node").repartition("key").sortWithinPartitions("key")
    sizes = nodes.select("node", "n")
    fitting = lambda pairs: pairs.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b").where(_fits(F.col("n"), F.col("m"))).select("a", "b")
    proposed = materialize(fitting(runs.mapInArrow(lambda it: _proposed(it, radius), "a long, b long").distinct()), "proposed")
    named = materialize(nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "first.*"), "named")
    own = with_hash_in(rows, named).join(named.select("node", F.col("th").alias("__th"), F.col("doc_id").alias("__id")), (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    sets = materialize(own.select("node", "__text").mapInArrow(_sets, "node long, hashes array<long>").dropDuplicates(["node"]), "sets")
    links = materialize(_checked(proposed, sets), "links")
    # where a key still holds several groups, the pairs across them
    labelled = materialize(_labelled(met.select("key", "band", "node", "n"), links), "labelled")
    keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("hashes")).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int")
    placed = labelled.join(keys.select("key", blocks.alias("blocks")), "key").withColumn("at", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    # pairs (i, j) of blocks with i <= j: a set of block x is on the first side of (x, j) and on the second of (i, x)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("at", x).alias("i"), F.greatest("at", x).alias("j"), F.when(x >= F.col("at"), 0).otherwise(1).alias("side")))
    placed = placed.select("node", "root", "band", "key", F.inline(pairs)).withColumn("task", F.xxhash64("key", "i", "j"))
    full = placed.join(sets, "node").join(nodes.select("node", "bands"), "node").select("task", "band", "side", "node", "root", "hashes", "bands")
    found = full.repartition("task").sortWithinPartitions("task").mapInArrow(_across, "a long, b long")
    links = links.unionByName(materialize(found.distinct(), "across"))
    return _labelled(sketches.select("doc_id", "th", "node"), links)
