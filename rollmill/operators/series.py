"""Metadata of series and an inverted index over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series_key
from ..spec import And, Eq, Or

INDEX_TYPES = ("filter", "aggregation", "group", "measurements")


def series_catalog(buckets: DataFrame, tags) -> DataFrame:
    """Per series: key, first, last and second-last bucket and their number. ``buckets`` are bucketed, so series are short."""
    distinct = buckets.groupBy(*tags, "bucket").agg(F.count(F.lit(1)).alias("__n"))
    last = F.max("bucket").over(Window.partitionBy(*tags))
    marked = distinct.withColumn("__last", last)
    return marked.groupBy(*tags).agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"),
        F.max(F.when(F.col("bucket") < F.col("__last"), F.col("bucket"))).alias("second_last"), F.count(F.lit(1)).alias("buckets"),
    ).withColumn("series", series_key(tags))


def top_buckets(buckets: DataFrame, tags, n: int = 2) -> DataFrame:
    """The last ``n`` different buckets per series, ranked from 1."""
    distinct = buckets.select(*tags, "bucket").distinct()
    rank = F.row_number().over(Window.partitionBy(*tags).orderBy(F.desc("bucket")))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= n)


def _entry(kind: str):
    return lambda w: F.struct(F.lit(kind).alias("type"), w.cast("string").alias("word"))


#: Ids that one row of the index holds, as bits of a long.
BLOCK = 6


def index_build(descriptions: DataFrame, id_col: str, types=None) -> DataFrame:
    """The inverted index as bitmaps: ``(type, word, block, bits)``, where bit i of a block stands for the id ``block * 64 + i``.

    A string gives one word, an array one per element; columns of other types are ignored, null words too. Bits are put together before the
    exchange; a word that many descriptions have takes a 64th of their rows. Ids are integers.
    """
    types = [t for t in (types or INDEX_TYPES) if t in descriptions.columns]
    entries = []
    for t in types:
        words = F.col(t) if descriptions.schema[t].dataType.typeName() == "array" else F.array(t)
        entries.append(F.transform(words, _entry(t)))
    rows = descriptions.select(F.col(id_col).cast("long").alias("id"), F.explode(F.flatten(F.array(*[F.coalesce(e, F.array().cast("array<struct<type:string,word:string>>")) for e in entries]))).alias("e"))
    bit = F.expr(f"shiftleft(1L, cast(id & {(1 << BLOCK) - 1} as int))")
    return rows.where(F.col("e.word").isNotNull() & F.col("id").isNotNull()).groupBy("e.type", "e.word", F.shiftright("id", BLOCK).alias("block")).agg(F.bit_or(bit).alias("bits"))


def _ids(bitmaps: DataFrame, *keep: str) -> DataFrame:
    """The ids of blocks, one row each."""
    here = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK) - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return bitmaps.select(*keep, "block", F.explode(here).alias("i")).select(*keep, (F.shiftleft("block", BLOCK) + F.col("i")).alias("id"))


def postings(index: DataFrame) -> DataFrame:
    """The index as rows ``(type, word, id)``."""
    return _ids(index, "type", "word")


def _leaves(node) -> list[Eq]:
    return [node] if isinstance(node, Eq) else [leaf for n in node.nodes for leaf in _leaves(n)]


def _search(index: DataFrame, words: list[tuple[str, str]], combine) -> DataFrame:
    """Ids whose bits remain when ``combine`` has put together the bits of each word (by its place in ``words``): one scan, one exchange by block, whatever the number of words."""
    wanted = {}
    for kind, word in words:
        wanted.setdefault(kind, set()).add(word)
    asked = reduce(lambda a, b: a | b, [(F.col("type") == kind) & F.col("word").isin(*sorted(ws)) for kind, ws in sorted(wanted.items())])
    bits = [F.coalesce(F.bit_or(F.when((F.col("type") == kind) & (F.col("word") == word), F.col("bits"))), F.lit(0).cast("long")).alias(f"w{k}") for k, (kind, word) in enumerate(words)]
    blocks = index.where(asked).groupBy("block").agg(*bits)
    return _ids(blocks.select("block", combine([F.col(f"w{k}") for k in range(len(words))]).alias("bits")).where(F.col("bits") != 0))


def _all(bits):
    return reduce(lambda a, b: a.bitwiseAND(b), bits)


def search_word(index: DataFrame, kind: str, word: str) -> DataFrame:
    return _search(index, [(kind, word)], _all)


def search_all(index: DataFrame, kind: str, words) -> DataFrame:
    """Ids that have all words."""
    return _search(index, [(kind, w) for w in sorted(set(words))], _all)


def search_tree(index: DataFrame, node, kind: str = "filter") -> DataFrame:
    """Ids that fit a filter tree: its bits joined by or and and in one pass over the blocks."""
    words = sorted({leaf.canonical() for leaf in _leaves(node)})

    def bits(n, of):
        if isinstance(n, Eq):
            return of[words.index(n.canonical())]
        if not isinstance(n, (Or, And)):
            raise ValueError(f"not a filter node: {n!r}")
        return reduce((lambda a, b: a.bitwiseOR(b)) if isinstance(n, Or) else (lambda a, b: a.bitwiseAND(b)), [bits(x, of) for x in n.nodes])

    return _search(index, [(kind, w) for w in words], lambda of: bits(node, of))


def match(index: DataFrame, props: dict[str, str | list[str]]) -> DataFrame:
    """Ids that have every word of every property."""
    return _search(index, sorted({(t, w) for t, ws in props.items() for w in ([ws] if isinstance(ws, str) else ws)}), _all)
