"""A toxicity classifier that is regularised against counterfactuals.

Logistic regression over the presence of words and word beginnings. Besides the usual penalty on
weights, every training text that mentions an identity term is paired with the same text with that term
swapped for another of its group, and the difference of the two scores is penalised: a neutral mention of a group
then weighs as much as that of any other, and nothing by itself.

The model is fitted on the driver from a bounded sample of labelled rows (``MAX_ROWS``); which of
its features count is found by Spark. Every text is scored.
"""

from __future__ import annotations

import collections
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many labelled rows of each class are used for fitting.
MAX_ROWS = 10_000
#: Letters of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
#: Weight of the counterfactual penalty and of the plain one.
COUNTERFACTUAL, RIDGE = 10.0, 1e-4
#: What missing a toxic text costs against a false alarm, in fitting.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7

# Identity terms; each group's terms can stand for one another.
IDENTITIES = (
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "blind", "deaf"), ("old", "young"), ("poor", "rich"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien", "juif"), ("frau", "mann"), ("frauen", "männer"), ("moslem", "christ", "jude"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano", "judío"),
)
_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words (``w:``) and beginnings (``b:``) of a text, in lower case."""
    found = set()
    for word in set(_LETTERS.findall((text or "").lower())):
        found.add("w:" + word)
        for n in BEGINNINGS:
            if len(word) > n:
                found.add("b:" + word[:n])
    return found


def swapped(words: set[str]) -> list[set[str]]:
    """The features with each identity term that occurs swapped for each other term of its group."""
    out = []
    for group in IDENTITIES:
        for term in group:
            if "w:" + term in words:
                out += [words - features(term) | features(other) for other in group if other != term]
    return out


@dataclass
class Model:
    """``score = sigmoid(bias + sum of the weights of the features present)``."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        words = set(_LETTERS.findall((text or "").lower()))
        begun = {w[:n] for w in words for n in BEGINNINGS if len(w) > n}
        total = self.bias + sum(map(self.whole.__getitem__, words & self.whole.keys())) + sum(map(self.begun.__getitem__, begun & self.begun.keys()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def __post_init__(self):
        self.whole = {k[2:]: v for k, v in self.weights.items() if k.startswith("w:")}
        self.begun = {k[2:]: v for k, v in self.weights.items() if k.startswith("b:")}


def fit(rows: list[tuple[int, float, list[int]]], swaps: list[tuple[list[int], list[int]]], names: list[str], ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> Model:
    """``rows``: label, row weight and feature numbers; ``swaps``: feature numbers of a text and of its counterfactual."""
    if not rows:
        return Model(bias=-2.0)
    y = np.array([r[0] for r in rows], float)
    weight = np.array([r[1] for r in rows], float)
    weight /= weight.sum()
    if y.min() == y.max():
        return Model(bias=math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    at = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    col = np.array([c for r in rows for c in r[2]], np.int64)
    s_at = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(swaps)]) if swaps else np.zeros(0, np.int64)
    s_col = np.array([c for a, b in swaps for c in (*a, *b)], np.int64)
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in swaps]) if swaps else np.zeros(0)
    k, w, bias = len(names), np.zeros(len(names)), 0.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(at, w[col], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad, gb = np.bincount(col, g[at], k) + ridge * w, g.sum()
        if swaps:
            gap = np.bincount(s_at, sign * w[s_col], len(swaps))
            grad += 2 * counterfactual / len(swaps) * np.bincount(s_col, sign * gap[s_at], k)
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.1 * (1 - 0.5 * step / steps)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model(float(bias), {n: float(x) for n, x in zip(names, w, strict=True) if x})


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _count_features(batches):
    """Pre-aggregated counts of features by label, a batch at a time."""
    for batch in batches:
        by = {0: collections.Counter(), 1: collections.Counter()}
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            by[toxic.as_py()].update(features(text.as_py()))
        keys = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()), pa.array([by[0][k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])


def _known(batches, numbers: dict[str, int]):
    for batch in batches:
        labels, found, pairs = [], [], []
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            own = features(text.as_py())
            labels.append(toxic.as_py())
            found.append(sorted(numbers[f] for f in own & numbers.keys()))
            pairs.append([x for other in swapped(own) for x in ([numbers[f] for f in (own - other) & numbers.keys()], [numbers[f] for f in (other - own) & numbers.keys()])])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(pairs, pa.list_(pa.list_(pa.int64())))], names=["toxic", "found", "pairs"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled rows of each class that are not held out, chosen by a hash of the id.

    Of rows that repeat an id the least text counts; null texts have no features. Without usable labels the score is constant.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("toxic").cast("long").alias("toxic")).distinct()
    totals = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    pick = None
    for label in (0, 1):
        one = usable.where(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(max_rows)
        pick = one if pick is None else pick.unionByName(one)
    # the sample's ids are bounded by max_rows, so they may be broadcast; the texts stay where they lie
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    # rows that repeat a labelled id count once, by their least text: the sample is bounded by its rows, too
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").persist()
    try:
        used = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
        n1, n0 = max(1, used.get(1, 0)), max(1, used.get(0, 0))
        counts = chosen.mapInArrow(_count_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        gap = F.col("t") / n1 - F.col("c") / n0
        spread = F.sqrt((F.col("t") + F.col("c") + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
        # toxic features: seldom in clean texts; and those most telling either way
        ratio = (F.col("t") + 0.1) / n1 / ((F.col("c") + 0.1) / n0)
        best = counts.where((F.col("t") + F.col("c") >= 3) & ((ratio > 3) | (ratio < 1 / 3))).withColumn("z", F.abs(gap / spread)).where("z > 3")
        names = [r.feature for r in best.orderBy(F.desc("z"), "feature").collect()]  # no more than the sample's texts have
        terms = ["w:" + t for group in IDENTITIES for t in group]
        names = list(dict.fromkeys(names + terms))
        numbers = {n: i for i, n in enumerate(names)}
        rows = chosen.mapInArrow(lambda it: _known(it, numbers), "toxic long, found array<long>, pairs array<array<long>>").collect()
    finally:
        chosen.unpersist()
    # the sample's classes at their true shares, a toxic text TOXIC_WEIGHT times
    prior = {label: totals.get(label, 0) / max(1, used.get(label, 0)) * (TOXIC_WEIGHT if label else 1) for label in (0, 1)}
    ordered = sorted((r.toxic, list(r.found), [list(p) for p in r.pairs]) for r in rows)
    swaps = [(p[i], p[i + 1]) for _, _, p in ordered for i in range(0, len(p), 2)]
    return fit([(t, prior[t], f) for t, f, _ in ordered], swaps, names)


def _scores(batches, model: Model):
    for batch in batches:
        got = [model.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``. Null and empty texts get the score of no features; a null id is not held out.

    Repeated rows are scored each, texts of any length in whole; other columns are ignored, an empty table gives none. The model, a dict of the sample's telling features, is sent with the task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _scores(it, model), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
