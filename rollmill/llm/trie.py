"""A prefix trie of conversations: every family's own small trie first, then one of all.

A conversation's family are those with its base id. Conversations are cogrouped with their base by family, rebuilt, and
merged to the family's trie; only nodes of families are shuffled to become nodes of all. A node is known by its depth and a 128-bit hash of
the turns up to it, a polynomial whose prefix sums can be shifted and put together from parts. So no step needs a conversation in
one place: turns are numbered across range partitions, and a family's turns are grouped by stretches of ``STRETCH`` positions, at most 100 times as many rows.

What a node sums over its subtree is gathered by families too: each node belongs to the one family that holds its smallest member, and
to the family trie above it goes only what the family owns, so a sum over families counts each node once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, materialize

#: Conversations of one family share ``conv_id - conv_id % FAMILY``; so many first turns at most come from the base.
FAMILY, HEAD = 100, 5
#: Positions of a conversation that one group of a family holds.
STRETCH = 1024
#: Multipliers of the two 64-bit halves of a hash (3 mod 8: their powers differ in a low bit), and their inverses.
R = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xC2B2AE3D27D4EB4B))
INVERSE = tuple(np.uint64(pow(int(r), -1, 1 << 64)) for r in R)
KEY = ("depth", "h1", "h2")


def shared_turns(conv_id: int) -> int:
    """How many of its first turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % (HEAD + 1)


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _power(r: np.uint64, n: np.ndarray) -> np.ndarray:
    """r^n modulo 2^64."""
    out, n, r = np.ones(len(n), np.uint64), n.astype(np.int64), np.array([r], np.uint64)
    while n.any():
        out = np.where(n & 1, out * r, out)
        r, n = r * r, n >> 1
    return out


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


# ---- positions and prefix hashes ---------------------------------------------------------------


def _numbered(batches):
    """Sorted rows with their position in their conversation and the sums of hashes up to it, both as far as this partition knows."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv_before, n_before, sums_before = None, 0, [np.uint64(0)] * 2
    for batch in batches:
        conv = _numbers(batch.column(0))
        if not len(conv):
            continue
        new = np.r_[True, conv[1:] != conv[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        goes_on = (start == 0) & (conv[0] == conv_before)
        pos = np.arange(len(conv)) - start + 1 + goes_on * n_before
        out = [batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(pos)]
        for k in (0, 1):
            own = _numbers(batch.column(1 + k)).view(np.uint64)
            total = np.cumsum(own * _power(R[k], pos), dtype=np.uint64)
            before = np.where(start > 0, total[start - 1], np.uint64(0))
            total = total - before + np.where(goes_on, sums_before[k], np.uint64(0))
            sums_before[k] = total[-1]
            out += [pa.array(total.view(np.int64)), batch.column(1 + k)]
        conv_before, n_before = conv[-1], pos[-1]
        yield pa.RecordBatch.from_arrays([*out, batch.column(3)], names=["conv_id", "part", "pos", "s1", "t1", "s2", "t2", "len"])


def _offsets(turns: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """For each part whose first conversation began in earlier parts: that conversation, its turns there and their sums. One row per partition is read."""
    last = {r.part: r.last for r in turns.groupBy("part").agg(F.max(F.struct("conv_id", "pos", "s1", "s2")).alias("last")).collect()}
    out, conv, n, sums = {}, None, 0, (0, 0)
    mask = (1 << 64) - 1
    for part in sorted(last):
        if conv is not None:
            out[part] = (conv, n, *sums)
        row = last[part]
        before = (n, sums) if row.conv_id == conv else (0, (0, 0))
        conv, n = row.conv_id, before[0] + row.pos
        sums = tuple(before[1][k] + pow(int(R[k]), before[0], 1 << 64) * (row[f"s{k + 1}"] & mask) & mask for k in (0, 1))
    return out


def _place(batches, offsets, stretch: int):
    for batch in batches:
        conv, part, pos = (_numbers(batch.column(c)) for c in ("conv_id", "part", "pos"))
        s = [_numbers(batch.column(c)).view(np.uint64).copy() for c in ("s1", "s2")]
        pos = pos.copy()
        for p in np.unique(part).tolist():
            if p in offsets:
                earlier, n, *sums = offsets[p]
                here = (part == p) & (conv == earlier)
                for k in (0, 1):
                    s[k][here] = s[k][here] * np.uint64(pow(int(R[k]), n, 1 << 64)) + np.uint64(sums[k])
                pos[here] += n
        columns = [batch.column("conv_id"), pa.array((pos - 1) // stretch), pa.array(pos), *[pa.array(x.view(np.int64)) for x in s], *[batch.column(c) for c in ("t1", "t2", "len")]]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "seg", "pos", "s1", "s2", "t1", "t2", "len"])


def turn_hashes(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per turn ``conv_id, base, seg, pos, s1, s2, t1, t2, len``: position from 1, hash of the turn and sums up to it, code points of the text.

    Turns go by ``turn`` (null first), then role and text. Rows are numbered in range partitions; a conversation that lies in several of them is put together from their ends.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    # equal rows are told apart, so that a range can end between them
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    ranged = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = ranged.select("conv_id", *[F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)], F.length("text").cast("long").alias("len"))
    turns = materialize(hashed.mapInArrow(_numbered, "conv_id long, part int, pos long, s1 long, t1 long, s2 long, t2 long, len long"), "turns")
    offsets = _offsets(turns)
    placed = turns.mapInArrow(lambda it: _place(it, offsets, stretch), "conv_id long, seg long, pos long, s1 long, s2 long, t1 long, t2 long, len long")
    return placed.withColumn("base", base_of(F.col("conv_id")))


# ---- tries of families -------------------------------------------------------------------------

_FAMILY_NODE = "base long, seg long, depth long, h1 long, h2 long, p1 long, p2 long, len long, n long, first long, ends array<long>, exits array<long>"


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _family(key, heads: pa.Table, turns: pa.Table, stretch: int) -> pa.Table:
    """The nodes of one family in one stretch of positions. ``heads``: first turns of the base (and of conversations that began in an earlier stretch); position 0 marks one that goes on in the next."""
    base, seg = (k.as_py() for k in key)
    head = {(c, p): (a, b, n) for c, p, a, b, n in zip(*[heads.column(f"h_{c}").to_pylist() for c in ("conv_id", "pos", "s1", "s2", "len")], strict=True)}
    order = np.lexsort([_numbers(turns.column("pos").combine_chunks()), _numbers(turns.column("conv_id").combine_chunks())])
    conv, pos, length = (_numbers(turns.column(c).combine_chunks())[order] for c in ("conv_id", "pos", "len"))
    s, t = ([_numbers(turns.column(f"{c}{k}").combine_chunks())[order].view(np.uint64) for k in (1, 2)] for c in "st")
    ids, at = np.unique(conv, return_inverse=True)
    wanted = np.array([shared_turns(c) for c in ids.tolist()], np.int64)
    n_base = max([p for c, p in head if c == base], default=0)
    got = np.minimum(wanted, n_base)
    if seg == 0:  # first turns are here
        for i in np.flatnonzero(pos <= HEAD).tolist():
            head[int(conv[i]), int(pos[i])] = (*[int(x[i].view(np.int64)) for x in s], int(length[i]))
    sums = lambda c, p, k: head[c, p][k] if p else 0
    own = pos > wanted[at]
    depth = pos - (wanted - got)[at]
    hashes, parents = [], []
    for k in (0, 1):
        start = np.array([sums(base, int(g), k) for g in got], np.int64).view(np.uint64)
        skipped = np.array([sums(c, int(w), k) if (c, int(w)) in head else 0 for c, w in zip(ids.tolist(), wanted, strict=True)], np.int64).view(np.uint64)
        h = start[at] + _power(INVERSE[k], wanted - got)[at] * (s[k] - skipped[at])
        hashes.append(h)
        parents.append(h - t[k] * _power(R[k], np.maximum(depth, 0)))
    nodes: dict[tuple[int, int, int], list] = {}

    def meet(c: int, node: tuple[int, int, int], parent: tuple[int, int], n: int) -> list:
        found = nodes.get(node)
        if found is None:
            found = nodes[node] = [*parent, n, 0, c, [], []]
        found[3] += 1
        found[4] = min(found[4], c)
        return found

    last: dict[int, list] = {}
    if seg == 0:
        for c, g in zip(ids.tolist(), got.tolist(), strict=True):
            last[c], above = meet(c, (0, 0, 0), (0, 0), 0), (0, 0)
            for d in range(1, g + 1):
                a, b, n = head[base, d]
                last[c], above = meet(c, (d, a, b), above, n), (a, b)
    rows = np.flatnonzero(own)
    deep = depth[rows].tolist()
    for c, d, a, b, x, y, n in zip(conv[rows].tolist(), deep, *[_signed(h[rows]) for h in (*hashes, *parents)], length[rows].tolist(), strict=True):
        last[c] = meet(c, (d, a, b), (x, y), n)
        if d % stretch == 0:
            last[c][6].append(c)
    for c, node in last.items():
        if (c, 0) not in head:
            node[5].append(c)
    columns = list(zip(*[(base, max(0, d - 1) // stretch, d, a, b, *rest) for (d, a, b), rest in nodes.items()], strict=True)) or [()] * 12
    kinds = [pa.int64()] * 10 + [pa.list_(pa.int64())] * 2
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _FAMILY_NODE.split(", ")])


def family_tries(placed: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per family, stretch of depths and node: the node, its parent's hash, code points of its last text, members, the smallest, those that end here, and those that go on from the stretch's last depth."""
    early = placed.where(F.col("pos") <= HEAD).select("base", "conv_id", "pos", "s1", "s2", "len")
    of_base = early.where(F.col("conv_id") == F.col("base"))
    # conversations of more than one stretch: a row for each further one
    later = placed.where((F.col("seg") > 0) & (F.col("pos") % stretch == 1)).select("base", "seg", "conv_id")
    cols = ["base", "seg", "conv_id", "pos", "s1", "s2", "len"]
    zero = F.lit(0).cast("long")
    heads = of_base.withColumn("seg", zero).select(*cols)
    heads = heads.unionByName(later.join(early.drop("base"), "conv_id").select(*cols))
    heads = heads.unionByName(later.select("base", "seg").distinct().join(of_base, "base").select(*cols))
    heads = heads.unionByName(later.select("base", (F.col("seg") - 1).alias("seg"), "conv_id", *[zero.alias(c) for c in cols[3:]]))
    heads = heads.select(*[F.col(c).alias(f"h_{c}") for c in cols])
    return heads.groupBy("h_base", "h_seg").cogroup(placed.groupBy("base", "seg")).applyInArrow(lambda key, head, turns: _family(key, head, turns, stretch), _FAMILY_NODE)


# ---- nodes of all ------------------------------------------------------------------------------

_SUMS = "depth long, h1 long, h2 long, leaves long, saved decimal(38,0), ends array<long>"


def _subtrees(key, carried: pa.Table, nodes: pa.Table) -> pa.Table:
    """Sums over subtrees of one family in one stretch of depths, of what the family owns; ``carried`` tells what a conversation owns deeper."""
    more = {c: (leaves, saved) for c, leaves, saved in zip(*[carried.column(f"c_{c}").to_pylist() for c in ("conv", "leaves", "saved")], strict=True)}
    found: dict[tuple[int, int, int], list] = {}
    for d, a, b, x, y, leaf, saved, ends, exits in zip(*[nodes.column(c).to_pylist() for c in (*KEY, "p1", "p2", "leaves", "saved", "ends", "exits")], strict=True):
        node = found.setdefault((d, a, b), [x, y, 0, 0, []])
        node[2] += leaf + sum(more[c][0] for c in exits if c in more)
        node[3] += int(saved) + sum(int(more[c][1]) for c in exits if c in more)
        node[4] += ends
    for d, a, b in sorted(found, reverse=True):
        x, y, leaves, saved, _ = found[d, a, b]
        above = found.get((d - 1, x, y)) if d else None
        if above is not None:
            above[2] += leaves
            above[3] += saved
    from decimal import Decimal

    columns = list(zip(*[(*k, v[2], Decimal(v[3]), sorted(v[4])) for k, v in found.items()], strict=True)) or [()] * 6
    kinds = [pa.int64()] * 4 + [pa.decimal128(38, 0), pa.list_(pa.int64())]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _SUMS.replace("(38,0)", "").split(", ")])


def _digests(batches):
    """Digest of each node's ids from rows sorted by node and id: one running digest, no list of them."""
    names = ["depth", "h1", "h2", "ends_sha256"]
    now, digest = None, None
    for batch in batches:
        done = []
        for d, a, b, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (d, a, b) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (d, a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, ends)).encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], pa.string() if k == 3 else pa.int64()) for k in range(4)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names=names)


def conversation_trie(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per node of the trie of rebuilt conversations ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A conversation is rebuilt from the first turns of its base (``shared_turns`` of them, or all it has) and its own later ones. Members of a node
    are the conversations that start with its turns, ``conv_id`` is the smallest. ``saved_tokens`` adds up (members - 1) times the code points of the last
    text over the subtree, ``ends_sha256`` is of the ids that end in the node.

    Null roles and texts are empty; rows without ``conv_id`` belong to no conversation and go; turns with one number go by role, then
    text, and repeated rows are turns of their own; an empty table has no node, not even a root; other columns are ignored. Ids may be negative: the remainder
    has the sign of the id. Texts are read once for their hash and length; conversations of any length are dealt out by stretches (of over ``HEAD`` positions).
    """
    families = materialize(family_tries(turn_hashes(conversations, stretch), stretch), "families")
    every = families.groupBy(*KEY).agg(F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("len").alias("len"), F.count(F.lit(1)).alias("rows"))
    every = materialize(every, "nodes")
    children = every.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1).cast("decimal(19,0)") * F.col("len").cast("decimal(19,0)")
    nodes = every.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("weight", saved.cast("decimal(38,0)"))
    nodes = materialize(nodes, "nodes-children")
    # what each family owns: nodes whose smallest member is its own
    told = nodes.select(*KEY, "rows", F.col("conv_id").alias("owner"), "weight", (F.col("n_children") == 0).cast("long").alias("leaf"))
    owned = keyed_join(families, told, list(KEY), "rows", ("base",))
    mine = F.col("first") == F.col("owner")
    owned = owned.select("base", "seg", *KEY, "p1", "p2", "owner", "ends", "exits", F.when(mine, F.col("leaf")).otherwise(0).cast("long").alias("leaves"), F.when(mine, F.col("weight")).otherwise(0).cast("decimal(38,0)").alias("saved"))
    owned = materialize(owned, "owned")
    deeper = owned.where((F.col("seg") > 0) & ((F.col("leaves") > 0) | (F.col("saved") > 0))).groupBy(F.col("owner").alias("conv_id"), "seg").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    exits = owned.where(F.size("exits") > 0).select("base", "seg", F.explode("exits").alias("conv_id"))
    asked = exits.withColumn("leaves", F.lit(0).cast("long")).withColumn("saved", F.lit(0).cast("decimal(38,0)"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rangeBetween(Window.unboundedPreceding, -1)
    both = asked.unionByName(deeper.withColumn("base", base_of(F.col("conv_id"))).select(*asked.columns).withColumn("base", F.lit(None).cast("long")))
    carried = both.select("base", "seg", "conv_id", F.coalesce(F.sum("leaves").over(below), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved").over(below), F.lit(0)).cast("decimal(38,0)").alias("saved")).where(F.col("base").isNotNull())
    carried = carried.select(F.col("base").alias("c_base"), F.col("seg").alias("c_seg"), F.col("conv_id").alias("c_conv"), F.col("leaves").alias("c_leaves"), F.col("saved").alias("c_saved"))
    sums = materialize(carried.groupBy("c_base", "c_seg").cogroup(owned.drop("owner").groupBy("base", "seg")).applyInArrow(_subtrees, _SUMS), "subtrees")
    totals = sums.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").cast("long").alias("saved_tokens"))
    ends = sums.where(F.size("ends") > 0).select(*KEY, "ends").repartition(*KEY).sortWithinPartitions(*KEY, F.array_min("ends"))
    digests = ends.mapInArrow(_digests, "depth long, h1 long, h2 long, ends_sha256 string")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below_root = nodes.where("depth > 0").select(*KEY, "p1", "p2")
    with_parent = keyed_join(below_root, parents, ["depth", "p1", "p2"], "n_children", ("h1", "h2")).select(*KEY, "parent_conv_id")
    out = nodes.join(totals, list(KEY)).join(digests, list(KEY), "left").join(with_parent, list(KEY), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
