"""Quality rules with risk-controlled thresholds, with built-in functions only.

Each rule is a number computed from a text; a document is rejected where one exceeds its
cutoff. The cutoffs are not guessed: on labelled documents every choice of one cutoff (or none) per rule
in every stratum is a hypothesis "together these rules reject more than ``risk`` of the stratum's good
documents". An exact binomial tail tests it, at a level divided by the number of
hypotheses (Bonferroni), so that with confidence ``1 - delta`` no chosen set of cutoffs anywhere rejects more
good documents than allowed. Each stratum takes the certified choice that rejects most of its bad documents; where
none is certified only the base rule acts. Documents that fail the base rule are rejected anyway and test nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Candidate cutoffs of a rule, from tight to loose.
CUTOFFS = (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: At most this share of the good documents of a stratum may be rejected by all rules together ...
RISK = 0.01
#: ... in all strata at once but for this chance.
DELTA = 0.05
#: The base rule, which needs no labels.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
#: Rules: shares that are large in bad texts.
RULES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (long) to every row.

    A null text has none of them: all are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__text", text)
    out = out.withColumn("__words", F.expr(r"filter(split(__text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn("word_chars", F.length(_without(F.col("__text"), ASCII_SPACE)).cast("long"))
    out = out.withColumn("n_symbols", (F.length("__text") - F.length(_without(F.col("__text"), SYMBOLS))).cast("long"))
    out = out.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(_without(x, ASCII_SPACE)) > 0))
    out = out.withColumn("n_lines", F.size("__lines").cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return out.withColumn("n_repeat_words", F.expr(_repeats("__words")))


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once, whatever the optimizer inlines."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeats(words: str) -> str:
    """SQL for the words that repeated windows cover.

    Hashes of the windows by doubling, of 2, 4, then 8 words; only a text with an equal pair goes on to sort them and to
    measure the union of the repeated windows.
    """
    double = lambda h, step: f"zip_with(slice({h}, 1, greatest(size({h}) - {step}, 0)), slice({h}, {step + 1}, greatest(size({h}) - {step}, 0)), (a, b) -> xxhash64(a, b))"
    ordered = "array_sort(zip_with(h, sequence(1, size(h)), (a, i) -> struct(a, i)))"
    flagged = "array_sort(transform(filter(sequence(1, size(s)), k -> (k > 1 and element_at(s, k - 1).a = element_at(s, k).a) or (k < size(s) and element_at(s, k + 1).a = element_at(s, k).a)), k -> element_at(s, k).i))"
    union = f"aggregate(p, struct(0L as n, -{WINDOW} as last), (z, i) -> struct(z.n + least({WINDOW}, i - z.last) as n, i as last), z -> z.n)"
    measured = f"CASE WHEN size(h) > size(array_distinct(h)) THEN {_let('s', ordered, _let('p', flagged, union))} ELSE 0L END"
    return _let("one", f"transform({words}, w -> xxhash64(w))", _let("two", double("one", 1), _let("four", double("two", 2), _let("h", double("four", 4), measured))))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_stats`` with all helper columns dropped.

    Computed behind a column that depends on the task, ``__task``: filters on the results stay above it and do not
    compute them again.
    """
    return text_stats(docs, text_col).withColumn("__task", F.spark_partition_id()).drop("__text", "__words", "__lines")


def certified_cutoffs(labelled: DataFrame, stratum: str = "stratum", good: str = "good", risk: float = RISK, delta: float = DELTA, cutoffs=CUTOFFS) -> DataFrame:
    """``(stratum, <rule> ..., n_good, n_rejected, n_bad_rejected)``: the certified cutoffs of each stratum that has some.

    ``labelled`` holds the stratum, ``good`` (boolean) and a column per rule. A choice of cutoffs is
    certified if ``P(Binomial(n_good, risk) <= n_rejected) <= delta / hypotheses``, where n_rejected counts the good documents
    that any of its rules rejects. Among equals in bad documents rejected the one with fewer good ones rejected wins, then the tighter one;
    a rule that is not used has a null cutoff.
    """
    at, none = list(RULES), len(cutoffs)
    ladder = F.array(*[F.lit(c) for c in cutoffs])
    # a document passes the i-th cutoff of a rule if at most i cutoffs lie below its value; i = none passes all
    below = lambda value: F.size(F.filter(ladder, lambda c: c < value))
    steps = [below(F.col(r)).alias(r) for r in at]
    cells = labelled.select(stratum, good, *steps).groupBy(stratum, *at).agg(F.count_if(F.col(good)).alias("g"), F.count_if(~F.col(good)).alias("b"))
    cells = materialize(cells, "cells")
    per = cells.groupBy(stratum).agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad")).where("n_good > 0")
    # the most rejections of good documents that are certified: the binomial tail is summed once a stratum, in logarithms; below 0: no number is
    per = per.withColumn("level", F.lit(delta) / (F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * ((none + 1) ** len(at) - 1)))
    most = f"""aggregate(sequence(0L, cast(floor(n_good * {risk}D) as bigint)), struct(n_good * ln(1 - {risk}D) as p, 0.0D as s, -1L as k),
        (z, i) -> struct(z.p + ln((n_good - i) / (i + 1.0D)) + ln({risk}D / (1 - {risk}D)) as p, z.s + exp(z.p) as s, if(z.s + exp(z.p) <= level, i, z.k) as k), z -> z.k)"""
    per = per.withColumn("most", F.expr(most)).where("most >= 0")
    grid = per.select(F.struct(stratum, "n_good", "n_bad", "most").alias("of"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("b"))
    for r in at:
        grid = grid.withColumn(r, F.explode(F.sequence(F.lit(0), F.lit(none))))
    found = cells.join(per.select(F.col(stratum).alias("__of"), "n_good", "n_bad", "most"), F.col(stratum).eqNullSafe(F.col("__of")))
    found = found.select(F.struct(stratum, "n_good", "n_bad", "most").alias("of"), "g", "b", *at)
    # documents that pass a choice: running sums over one rule after the other
    sums = grid.unionByName(found).groupBy("of", *at).agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    for r in at:
        upto = Window.partitionBy("of", *[x for x in at if x != r]).orderBy(r).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumns({"g": F.sum("g").over(upto), "b": F.sum("b").over(upto)})
    rows = sums.select(F.col(f"of.{stratum}").alias(stratum), F.col("of.n_good").alias("n_good"), F.col("of.most").alias("most"), *at, (F.col("of.n_good") - F.col("g")).alias("n_rejected"), (F.col("of.n_bad") - F.col("b")).alias("n_bad_rejected"))
    best = F.min(F.struct((-F.col("n_bad_rejected")).alias("o"), "n_rejected", *at, "n_good", "n_bad_rejected")).alias("c")
    rows = rows.where("n_rejected <= most").groupBy(stratum).agg(best)
    return rows.select(stratum, *[F.get(ladder, F.col(f"c.{r}")).alias(r) for r in at], "c.n_good", "c.n_rejected", "c.n_bad_rejected")


def quality_verdicts(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``labels`` holds ``(doc_id, quality)``; quality 1 is good. Strata without enough labelled
    documents certify nothing, so only the base rule rejects there. A null stratum is one of
    its own, null texts count as empty (and fail the base rule), repeated rows are judged each. Without labels only the base rule acts.
    """
    stats = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text")))
    stats = materialize(stats.drop("text", "__task"), "stats")
    return verdicts(stats, None if labels is None else cutoff_table(stats, labels, id_col, risk, delta))


def cutoff_table(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(__stratum, __<rule> ...)``: one row per stratum with certified cutoffs; a rule without one is null.

    An id that is labelled several times is good if any label says so; labels without quality count as none.
    """
    said = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"))
    labelled = with_rules(stats).where(f"NOT ({BASE_FAILED})").select("doc_id", "stratum", *RULES).join(said, "doc_id")
    chosen = certified_cutoffs(labelled, risk=risk, delta=delta)
    return materialize(chosen.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__{r}") for r in RULES]), "cutoffs")


def with_rules(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(v) for k, v in RULES.items()})


def verdicts(stats: DataFrame, cutoffs: DataFrame | None) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows with the columns of ``measured`` and ``stratum``; drops the stratum."""
    out = with_rules(stats).withColumn("base_failed", F.expr(BASE_FAILED))
    bad = F.lit(False)
    if cutoffs is not None:
        out = out.join(cutoffs, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
        for k in RULES:
            bad = bad | F.coalesce(F.col(k) > F.col(f"__{k}"), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~bad)
    return out.drop(*RULES, "stratum", "n_lines", "__stratum", *[f"__{k}" for k in RULES])
