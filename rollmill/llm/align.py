"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how often two tokens meet.

The tokens of both sides are nodes of a bipartite graph; two are linked where their bytes overlap. Its connected
components, found by union-find, are exactly the smallest groups that both sides cut alike. Links are counted over
the corpus in three steps: per document, in each task before the shuffle, then per pair.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, materialize, small
from .packing import ByteBpe
from .pieces import SPACE, Pieces

#: A table of pairs with at most so many rows (32 MB) goes to every executor; a larger one is joined by a shuffle, with frequent pairs dealt out.
SENT = 1_000_000
#: A pair of ids in one number: the first in the upper bits.
BITS = 32


class Aligner:
    """Two vocabularies that a worker holds, and the alignment of a list of texts, which lie one after the other in arrays."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteBpe(path_a).bpe
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shows = Pieces(path_b).shows
        ranks = self.a._mergeable_ranks
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size_a[i] = len(token)
        self.size_b = np.array([len(s) for s in shows], np.int64)
        #: Each id as it is written before a comma and at the end of its side of a group; the ids of A, then of B.
        self.written = [f"{i}{end}" for n, last in ((len(self.size_a), "|"), (len(shows), ";")) for i in range(n) for end in (",", last)]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides of texts that are not empty, each after a space (side B adds it)."""
        a = [self.a.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]
        return a, [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of A and B whose bytes overlap: those of B from the first that ends behind the start of one of A to the last that starts before its end."""
        size_a, size_b = self.size_a[a], self.size_b[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        if len(a) and end_a[-1] != end_b[-1]:
            raise ValueError("the tokens of both sides do not cover the same bytes")
        low = np.searchsorted(end_b, end_a - size_a, "right")
        n = np.searchsorted(end_b - size_b, end_a, "left") - low
        i = np.repeat(np.arange(len(a)), n)
        return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]

    @staticmethod
    def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Union-find over all links at once: the smallest node of each node's component. Roots of linked nodes are hooked to the smaller one, then paths are halved until all are flat."""
        over = np.arange(n)
        while True:
            rx, ry = over[x], over[y]
            apart = rx != ry
            if not apart.any():
                return over
            x, y = x[apart], y[apart]
            np.minimum.at(over, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while True:
                above = over[over]
                if (above == over).all():
                    break
                over = above

    def align(self, texts: list[str]):
        """Per text: tokens of A and B, groups, links, the groups as text, and the linked pairs of ids with their number."""
        got_a, got_b = self.tokens(texts)
        n_a, n_b = [np.array([len(x) for x in got], np.int64) for got in (got_a, got_b)]
        a, b = np.concatenate(got_a), np.concatenate(got_b)
        i, j = self.links(a, b)
        over = self.components(len(a) + len(b), i, j + len(a))
        # every component holds a token of A, so its smallest node is one; components follow each other as in the text
        first = over[: len(a)] == np.arange(len(a))
        number = np.cumsum(first) - 1
        group_a, group_b = number[over[: len(a)]], number[over[len(a) :]]
        many_a, many_b = np.bincount(group_a, minlength=first.sum()), np.bincount(group_b, minlength=first.sum())
        upto_a, upto_b = np.cumsum(many_a), np.cumsum(many_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[upto_a - 1] = last_b[upto_b - 1] = 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (upto_b - many_b)[group_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + upto_a[group_b]] = 2 * (b + len(self.size_a)) + last_b
        pair = a[i] << BITS | b[j]
        stop_a, stop = np.cumsum(n_a), np.cumsum(n_a + n_b)
        stop_links = np.searchsorted(i, stop_a, "left")
        n_groups = np.add.reduceat(first, stop_a - n_a) if len(a) else first
        written, at, at_link, out = self.written, 0, 0, []
        for k in range(len(texts)):
            shown = "".join(map(written.__getitem__, codes[at : stop[k]].tolist()))[:-1]
            out.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(stop_links[k] - at_link), shown, np.unique(pair[at_link : stop_links[k]], return_counts=True)))
            at, at_link = stop[k], stop_links[k]
        return out

    def texts(self, texts: list[str | None]):
        """As ``align``, with nothing for texts that are null, empty, or that side B does not give back (it writes spaces as U+2581)."""
        usable = [k for k, t in enumerate(texts) if t and SPACE not in t]
        nothing = np.zeros(0, np.int64)
        out = [(0, 0, 0, 0, "", (nothing, nothing))] * len(texts)
        for k, made in zip(usable, self.align([texts[k] for k in usable]) if usable else (), strict=True):
            out[k] = made
        return out


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _align(batches, path_a: str, path_b: str):
    by = aligner(path_a, path_b)
    for batch in small(batches):
        done = by.texts([t.as_py() for t in batch.column(batch.num_columns - 1)])
        columns = [pa.array([d[k] for d in done], pa.int64()) for k in range(4)]
        ends = np.cumsum([0, *[len(d[5][0]) for d in done]])
        flat = [pa.array(np.concatenate([d[5][k] for d in done]), pa.int64()) for k in (0, 1)]
        pairs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["pair", "n"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.array([d[4] for d in done], pa.string()), pairs], names=[*batch.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])


def align(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per document ``keep, n_a, n_b, n_groups, n_links, groups, pairs``: its groups as ``a1,a2|b1;a3|b2,b3``, and its linked pairs of ids with their number.

    Side A is a byte-level vocabulary, side B one of pieces; both take a space before the text, and no special tokens. A null or
    empty text, and one with U+2581 (which B gives back as a space), has no tokens: zeros, an empty text and no pairs. Repeated rows are
    aligned each; columns beside ``keep`` are ignored; an empty table gives an empty one. The work grows with a text's length, not faster. No shuffle.
    """
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_a long", "n_b long", "n_groups long", "n_links long", "groups string", "pairs array<struct<pair:long,n:long>>"])
    return rows.mapInArrow(lambda it: _align(it, path_a, path_b), schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked pair of ids ``a, b, count`` (links over the corpus that hold it) and ``best``: no other pair of this b has a higher count (ties included)."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("count"))
    counts = counts.select(F.shiftright("pair", BITS).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int").alias("b"), "count")
    # a window over one id of B holds at most as many rows as A has ids
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def score(aligned: DataFrame, counts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per row of ``aligned`` its ``columns``, ``n_best`` (links whose pair is a best one) and ``count_sum`` (its links' counts added up).

    ``aligned`` must be a written table: rows are told apart by their place in it.
    """
    one = aligned.withColumn("__row", F.monotonically_increasing_id())
    links = one.select("__row", *columns, F.explode("pairs").alias("p")).select("__row", *columns, "p.pair", F.col("p.n").alias("__n"))
    table = counts.select((F.shiftleft(F.col("a").cast("long"), BITS).bitwiseOR(F.col("b").cast("long"))).alias("pair"), "count", "best")
    if counts.count() <= SENT:
        joined = links.join(F.broadcast(table), "pair")
    else:
        met = aligned.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.count(F.lit(1)).alias("rows"))
        joined = keyed_join(links, table.join(met, "pair"), ["pair"], "rows", ("__row",))
    sums = joined.groupBy("__row", *columns).agg(F.sum(F.when(F.col("best"), F.col("__n")).otherwise(0)).alias("n_best"), F.sum(F.col("__n") * F.col("count")).alias("count_sum"))
    none = one.where(F.size("pairs") == 0).select("__row", *columns, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return sums.unionByName(none).drop("__row")


def align_and_score(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Scores per document (``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``) and the corpus's pair counts.

    The alignment is written once to the shared folder, with a digest in place of the groups. Nulls, repeats and so on: see ``align``; a null ``doc_id`` is an id like others.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    aligned = materialize(align(docs, path_a, path_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs"), "aligned")
    counts = materialize(pair_counts(aligned), "pair-counts")
    return score(aligned, counts, ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), counts
