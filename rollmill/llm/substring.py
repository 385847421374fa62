"""Exact substring dedup: removing every byte that a repeated string of 400 bytes covers.

A suffix array over the whole corpus would not be spread, so the work is cut along the text itself. Every
400-byte window has an anchor, the least hash among the 65-byte strings inside it, which equal windows share at
the same place. Windows with one anchor form its context. Contexts under one hash that are all equal need no
sorting: they are repeated as a whole. Where contexts under a hash differ, repeats start or end inside them. These are cut
into short ranges of windows: what all windows of a range have in common is its core, and only ranges with equal
cores can hold equal windows. Their bytes before and after the core, with the core as one symbol, go into a
suffix array (``suffixes``), in which a window is repeated if and only if it shares 400 bytes with a neighbour.

Groups of any size are split before they reach a task: a core with many ranges is halved (each half has a longer core)
until its ranges are few or all equal, at the latest when each holds one window. Joins deal rows of a frequent key out to several tasks.

Passages of over 50 words that other documents hold too are found in the same way, with words as symbols; they are
reported beside the bytes, as many are shorter than 400 bytes.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, materialize, with_hash_in
from .suffixes import repeated_starts


@dataclass(frozen=True)
class Unit:
    """What is compared: windows of ``length`` symbols of ``width`` bytes, anchored by strings of ``kmer`` symbols, ``range`` windows in a first range."""

    length: int
    kmer: int
    range: int
    width: int
    #: Whether a string must occur in another document, or may occur in the same one again.
    across: bool

    @property
    def span(self) -> int:
        return self.length - self.kmer + 1

    def symbols(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8) if self.width == 1 else word_symbols(text)


BYTES = Unit(400, 65, 48, 1, False)
#: Runs of over 50 words.
WORDS = Unit(51, 9, 8, 4, True)
LENGTH = BYTES.length
#: A range is halved so often before suffixes are sorted.
SPLITS = 2
#: Ranges of one core that one suffix array may take.
MAX_CORE = 4096
#: Symbols of one suffix array, about.
SYMBOLS = 60_000
MAX_TASKS = 50_000
#: Bytes hashed at a time; a longer text is worked through in overlapping parts.
PART = 1 << 22

_A = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step = 1
    while step < n:
        more = min(step, n - step)
        out[step : step + more] = out[:more] * (out[step - 1 : step] * np.uint64(base))
        step += more
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def _sums(x: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(base, _room(len(x)))[: len(x)], out=out[1:])
    return out


def _room(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def _hashes(sums: np.ndarray, base: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hashes of x[at:to], equal for equal strings wherever they are."""
    inverse = _powers(pow(base, -1, 1 << 64), _room(len(sums)))
    return _mix((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64))


def word_symbols(text: bytes) -> np.ndarray:
    """A 32-bit hash for each word of a text."""
    out, at = [], 0
    while at < len(text):
        to = at + PART
        while to < len(text) and not _SPACE[text[to]]:  # a part ends between words
            to += 1
        x = np.frombuffer(text, np.uint8, min(to, len(text)) - at, at)
        word = np.concatenate(([False], ~_SPACE[x], [False]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        a, b = edge[::2], edge[1::2]
        made = _hashes(_sums(x, _A), _A, a, b).astype(np.uint32)
        for i in np.flatnonzero(b - a > 64):
            made[i] = xxhash.xxh32_intdigest(text[at + a[i] : at + b[i]])
        out.append(made)
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def anchors(symbols: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """Per anchor: hash of its string, two hashes of its context, first window, place of the string, last window."""
    parts, length, kmer = [], unit.length, unit.kmer
    for base in range(0, max(1, len(symbols) - length + 1), PART):
        x = symbols[base : base + PART + length - 1]
        if len(x) < length:
            continue
        at = np.arange(len(x) - kmer + 1)
        h = _hashes(_sums(x, _A), _A, at, at + kmer)
        low = np.uint64((1 << 24) - 1)
        least = (h & ~low) | at.astype(np.uint64)
        width, span = 1, unit.span
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: width - span], least[span - width :])
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        hi = np.append(lo[1:], len(least)) - 1
        pos = (least[lo] & low).astype(np.int64)
        data, w = x.tobytes(), unit.width
        digest = xxhash.xxh3_128_digest
        context = b"".join([digest(data[i * w : (j + length) * w], p) for i, j, p in zip(lo.tolist(), hi.tolist(), (pos - lo).tolist(), strict=True)])
        context = np.frombuffer(context, np.uint64).reshape(-1, 2)
        parts.append((h[pos], context[:, 0], context[:, 1], lo + base, pos + base, hi + base))
    if not parts:
        parts = [(np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 3]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


_ANCHORS = (("h", np.int64), ("c", np.int64), ("e", np.int64), ("lo", np.int32), ("pos", np.int32), ("hi", np.int32))


def _scan(batches):
    for batch in batches:
        size, sha, found = [], [], {BYTES: [], WORDS: []}
        for text in batch.column(batch.num_columns - 1):
            data = (text.as_py() or "").encode()
            size.append(len(data))
            sha.append(hashlib.sha256(data).hexdigest())
            for unit, into in found.items():
                into.append(anchors(unit.symbols(data), unit))
        lists, names = [], []
        for unit, own in found.items():
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in own]))).astype(np.int32))
            for c, (name, kind) in enumerate(_ANCHORS):
                flat = np.concatenate([f[c] for f in own])
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64) if c < 3 else flat.astype(kind))))
                names.append(f"{name}{unit.width}")
        own = [pa.array(size, pa.int64()), pa.array(sha, pa.string()), *lists]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], "n_bytes", "sha", *names])


def _ranges(batches, unit: Unit):
    """Ranges of the asked contexts of each text, with their cores' hashes and the symbols around the cores."""
    span, length, w = unit.span, unit.length, unit.width
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("lt", pa.binary()), ("rt", pa.binary())])
    for batch in batches:
        key, rows, starts, lts, rts = [], [], [], [], []
        for row, asked, text in zip(*batch.columns, strict=True):
            row, data = row.as_py(), unit.symbols(text.as_py().encode()).tobytes()
            for ask in asked.as_py():
                lo, pos, hi = ask["lo"], ask["pos"], ask["hi"]
                base = pos - span + 1
                for q in range((lo - base) // unit.range, (hi - base) // unit.range + 1):
                    a, b = base + q * unit.range, base + (q + 1) * unit.range - 1
                    s, e = max(lo, a), min(hi, b)
                    key.append(xxhash.xxh3_128_digest(data[b * w : (a + length) * w]))
                    rows.append(row)
                    starts.append(s)
                    lts.append(data[s * w : b * w])
                    rts.append(data[(a + length) * w : (e + length) * w])
            if len(rows) > 20_000:
                yield _range_batch(schema, key, rows, starts, lts, rts)
                key, rows, starts, lts, rts = [], [], [], [], []
        yield _range_batch(schema, key, rows, starts, lts, rts)


def _range_batch(schema, key, rows, starts, lts, rts):
    keys = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(lts, pa.binary()), pa.array(rts, pa.binary())], schema=schema)


def _halves(ranges: DataFrame, windows: int, w: int) -> list[tuple[DataFrame, int]]:
    """Ranges of ``windows`` windows as two tables of fewer, with their numbers of windows; each core grows by the ``w``-byte symbols that its half has in common."""
    left = windows - windows // 2
    right = windows - left
    own = lambda side, extra: [F.xxhash64("k1", "k2", F.lit(side), extra).alias("k1"), F.xxhash64("k2", extra, F.lit(side), F.hash("k1", extra)).alias("k2")]
    nl, nr = F.length("lt"), F.length("rt")
    more = w * (windows - left)
    one = ranges.where(nl >= more).select(*own(0, F.expr(f"substring(lt, length(lt) - {more} + 1, {more})")), "row", "start", F.expr(f"substring(lt, 1, length(lt) - {more})").alias("lt"), F.expr(f"substring(rt, 1, {w * (left - 1)})").alias("rt"))
    drop = F.greatest(F.lit(0), nl - w * (right - 1))
    two = ranges.where(nr >= w * left).select(*own(1, F.expr(f"substring(rt, 1, {w * left})")), "row", (F.col("start") + drop / w).cast("int").alias("start"), F.expr(f"substring(lt, greatest(0, length(lt) - {w * (right - 1)}) + 1, {w * windows})").alias("lt"), F.expr(f"substring(rt, {w * left} + 1, {w * windows})").alias("rt"))
    return [(one.unionByName(two), left)] if left == right else [(one, left), (two, right)]


def _sorted_suffixes(batches, unit: Unit):
    """Rows in runs of a core; several cores share a suffix array. Yields the symbols that repeated windows cover."""
    held: list[pa.RecordBatch] = []
    kind = np.uint8 if unit.width == 1 else np.uint32

    def solve(table: pa.Table):
        s, weight, owners = [], [], []
        core, last = 1 << 8 * unit.width, None
        for k1, k2, windows, row, start, lt, rt in zip(*(table.column(c).to_pylist() for c in ("k1", "k2", "windows", "row", "start", "lt", "rt")), strict=True):
            if (k1, k2) != last:
                last, core = (k1, k2), core + 1
            lt, rt = np.frombuffer(lt, kind).tolist(), np.frombuffer(rt, kind).tolist()
            owners.append((row, start, len(s), len(lt) + 1))
            s += [x + 1 for x in lt]
            s.append(core)
            s += [x + 1 for x in rt]
            s.append(0)
            weight += [1] * len(lt)
            weight.append(unit.length - windows + 1)
            weight += [1] * (len(rt) + 1)
        place = None
        if unit.across:
            place = [0] * len(s)
            for (row, _, at, _), end in zip(owners, [o[2] for o in owners[1:]] + [len(s)], strict=True):
                place[at:end] = [row] * (end - at)
        flags = repeated_starts(s, weight, unit.length, 0, place)
        rows, los, his = [], [], []
        for row, start, at, n in owners:
            i = 0
            while i < n:
                if flags[at + i]:
                    j = i
                    while j + 1 < n and flags[at + j + 1]:
                        j += 1
                    rows.append(row)
                    los.append(start + i)
                    his.append(start + j + unit.length)
                    i = j
                i += 1
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32())], names=["row", "a", "b"])

    def take(last: bool):
        nonlocal held
        table = pa.Table.from_batches(held)
        key = table.column("k1").to_numpy()
        size = table.column("size").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        upto = np.concatenate(([0], np.cumsum(size)))
        done, at = 0, 0
        for k in starts[1:]:  # a run is whole once the next begins
            if upto[k] - upto[at] >= SYMBOLS:
                yield solve(table.slice(at, k - at))
                at = done = int(k)
        if last:
            yield solve(table.slice(at))
            held = []
        else:
            held = table.slice(done).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        yield from take(False)
    if held:
        yield from take(True)


def _ranged_repeats(ranges: DataFrame, unit: Unit) -> DataFrame:
    """``(row, a, b)``: the symbols that repeated windows of the ranges cover."""
    covers, groups, queue = [], [], [(ranges, unit.range, 0)]
    while queue:
        now, windows, depth = queue.pop()
        tails = F.xxhash64(F.length("lt"), "lt", "rt")
        cores = now.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(tails).alias("low"), F.max(tails).alias("high"), F.min("row").alias("r"), F.max("row").alias("s"))
        cores = materialize(cores.where("r < s" if unit.across else "n > 1").select("k1", "k2", "n", (F.col("low") == F.col("high")).alias("same")), "cores")
        known = materialize(keyed_join(now, cores, ["k1", "k2"], "n", ("row", "start")), "ranges")
        # equal ranges are repeated as a whole: their windows are those that the symbols around the core reach
        first, last = F.col("start"), F.col("start") + (F.length("lt") + F.length("rt")) / unit.width + F.lit(unit.length - windows + 1)
        covers.append(known.where("same").select("row", first.alias("a"), last.cast("int").alias("b")))
        mixed = known.where("NOT same")
        if depth >= SPLITS:
            groups.append(mixed.where(F.col("n") <= MAX_CORE).withColumn("windows", F.lit(windows)))
            mixed = mixed.where(F.col("n") > MAX_CORE)
        mixed = mixed.select("k1", "k2", "row", "start", "lt", "rt")
        if windows > 1 and not mixed.isEmpty():
            queue += [(half, n, depth + 1) for half, n in _halves(mixed, windows, unit.width)]
    rows = functools.reduce(DataFrame.unionByName, groups) if groups else None
    out = functools.reduce(DataFrame.unionByName, covers)
    if rows is not None:
        rows = rows.withColumn("size", F.ceil((F.length("lt") + F.length("rt")) / unit.width).cast("int") + 2)
        # few bytes but much work: a number of tasks by symbols, which adaptive execution does not merge
        tasks = -(-(rows.agg(F.sum("size")).first()[0] or 0) // (2 * SYMBOLS))
        rows = rows.repartition(max(1, min(MAX_TASKS, tasks)), "k1", "k2").sortWithinPartitions("k1", "k2")
        rows = rows.select("k1", "k2", "windows", "size", "row", "start", "lt", "rt")
        out = out.unionByName(rows.mapInArrow(lambda it: _sorted_suffixes(it, unit), "row long, a int, b int"))
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts joined to the rows of ``wanted (doc_id, th, ...)``; others are kept out of the shuffle as far as a filter of bounded size tells.

    Of rows that repeat id and text one stands for all, so that they do not meet each other.
    """
    kept = with_hash_in(docs, wanted)
    kept = kept.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.first("text").alias("text"))
    return wanted.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).drop("__id", "__th")


def _remove(text: bytes, covers: list[dict]) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs, SHA-256 of the rest."""
    removed = spans = at = 0
    end = -1
    kept = hashlib.sha256()
    for a, b in sorted((c["a"], c["b"]) for c in covers):
        if a > end:
            spans += 1
            kept.update(text[at:a])
            removed, end = removed + b - a, b
        elif b > end:
            removed, end = removed + b - end, b
        at = end
    kept.update(text[at:])
    return removed, spans, kept.hexdigest()


def _removed(batches):
    for batch in batches:
        got = [_remove(t.as_py().encode(), c.as_py()) for c, t in zip(batch.column("covers"), batch.column("text"), strict=True)]
        own = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *own], names=["row", "n_removed", "n_spans", "kept_sha256"])


def _covers(rows: DataFrame, scanned: DataFrame, unit: Unit) -> DataFrame:
    """``(row, a, b)``: the symbols that repeated strings of a unit's length cover, by the rows of ``scanned``."""
    names = [n for n, _ in _ANCHORS]
    every = scanned.select("row", F.explode(F.arrays_zip(*[F.col(f"{n}{unit.width}").alias(n) for n in names])).alias("x")).select("row", "x.*")
    # hashes that occur twice; whether all their contexts are equal
    seen = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c", "e")).alias("low"), F.max(F.struct("c", "e")).alias("high"), F.min("row").alias("r"), F.max("row").alias("s"))
    seen = materialize(seen.where("r < s" if unit.across else "n > 1").select("h", "n", (F.col("low") != F.col("high")).alias("mixed")), "seen")
    near = materialize(keyed_join(every, seen, ["h"], "n", ("row", "lo")).drop("n"), "near")
    contexts = near.groupBy("h", "c", "e").agg(F.count(F.lit(1)).alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("row", "lo", "pos", "hi")).alias("one"), F.max("row").alias("last"))
    contexts = materialize(contexts, "contexts")
    again = contexts.where(F.col("one.row") < F.col("last") if unit.across else F.col("n") > 1).select("h", "c", "e", "n")
    whole = keyed_join(near, again, ["h", "c", "e"], "n", ("row", "lo")).select("row", F.col("lo").alias("a"), (F.col("hi") + unit.length).alias("b"))
    # one occurrence of each context under a mixed hash; all of a context with more are covered above
    asked = contexts.where("mixed").groupBy(F.col("one.row").alias("row")).agg(F.collect_list(F.struct("one.lo", "one.pos", "one.hi")).alias("asked"))
    asked = materialize(asked.join(scanned.select("row", "doc_id", "th"), "row"), "asked")
    ranges = _texts_of(rows, asked).select("row", "asked", "text").mapInArrow(lambda it: _ranges(it, unit), "k1 long, k2 long, row long, start int, lt binary, rt binary")
    return materialize(whole.unionByName(_ranged_repeats(materialize(ranges, "ranges"), unit)), "covers")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage``.

    ``shares_passage`` is 1 if the document holds over 50 words in a row that another document holds too.
    Null texts count as empty; texts of under 400 bytes lose nothing; repeated rows repeat each other's strings
    and lose all of them. A null id is an id like any other. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{n}{u.width} array<{'int' if k is np.int32 else 'long'}>" for u in (BYTES, WORDS) for n, k in _ANCHORS)
    scanned = rows.mapInArrow(_scan, f"doc_id {kind}, th long, n_bytes long, sha string, {lists}")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    covers = _covers(rows, scanned, BYTES).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("covers"))
    covered = materialize(covers.join(scanned.select("row", "doc_id", "th", "n_bytes"), "row"), "covered")
    cut = _texts_of(rows, covered.select("row", "doc_id", "th", "covers")).select("row", "covers", "text").mapInArrow(_removed, "row long, n_removed long, n_spans long, kept_sha256 string")
    shared = _covers(rows, scanned, WORDS).select("row").distinct().withColumn("shares", F.lit(1))
    out = scanned.select("row", "doc_id", "n_bytes", "sha").join(cut, "row", "left").join(shared, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("shares", F.lit(0)).alias("shares_passage"),
    )
