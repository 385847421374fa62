"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Every source is a queue. Its documents, in a shuffled order that a hash fixes, are
served one after the other; a document's virtual start and finish times are the words
its source has served before and after it, over the source's target. Served in the
order of their finish times, all sources reach their targets at virtual time 1, which is
where the total budget is spent: the mix is the global order by finish time, cut
there. A document that is being served at virtual time 1 counts as two pieces, before and after; pieces are
range-sorted by finish time and running sums over the range partitions, then inside them, cut them at the budget.

A source whose target exceeds its size is served again (a new epoch with a new shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MAX_EPOCHS = 3
#: Documents of one source that are ordered by one task; running sums over groups of
#: that many go from group to group, so that a source of any size is spread.
GROUP_ROWS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """``(source, docs, source_size, weight, target)`` from rows ``(source, size)``.

    The budget (all words by default) is shared by weight; a target stops at
    ``max_epochs`` times its source's size and the excess goes to the others by weight
    until none is above. In closed form: with sources in order of cap over weight, the first
    ones are capped, and the rest shares what is left. One row per source: small.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(everything).cast("double") if budget is None else F.lit(float(budget))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    per = per.withColumn("level", left / F.sum("weight").over(after))
    per = per.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    per = per.withColumn("level", F.max("open").over(everything))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return per.select("source", "docs", "source_size", "weight", target.alias("target"))


def ticket(doc_id: Column, epoch: Column) -> Column:
    """A document's place in the shuffled order of an epoch: equal in every run."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), epoch.cast("string")).cast("binary"))


def _share(h: Column, groups: Column) -> Column:
    """Group number 0 .. groups-1 from the first six digits of a hexadecimal hash, in hash order."""
    return F.floor(F.conv(F.substring(h, 1, 6), 16, 10).cast("long") * groups / F.lit(1 << 24)).cast("long")


def virtual_times(sized: DataFrame, targets: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document and epoch in which it may be served.

    ``sized`` holds ``(row, doc_id, source, size)`` and any further columns. Adds
    ``source_size, target, epoch, ticket, start, finish, inner``; documents of a source are served in order of their tickets, start and finish are virtual
    times, inner counts the words served up to virtual time 1.
    """
    joined = sized.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left")
    epochs = F.greatest(F.lit(1), F.least(F.lit(max_epochs), F.ceil(F.try_divide(F.col("target"), F.col("source_size"))))).cast("int")
    rows = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.coalesce(epochs, F.lit(1)) - 1)))
    # documents without an id go by their text's hash, if there is one, or all would meet in one group
    own = F.col("doc_id").cast("string")
    if "th" in rows.columns:
        own = F.coalesce(own, F.concat(F.lit("#"), F.col("th").cast("string")))
    rows = rows.withColumn("ticket", ticket(own, F.col("epoch")))
    rows = rows.withColumn("__g", _share(F.col("ticket"), F.ceil(F.col("docs") / GROUP_ROWS)))
    rows = rows.withColumn("__source", F.coalesce(F.col("source"), F.lit(""))).withColumn("__null", F.col("source").isNull())
    keys = ["__source", "__null", "epoch", "__g"]
    sums = rows.groupBy(*keys).agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("__source", "__null", "epoch").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*keys).orderBy("ticket", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, keys)
    end = F.col("__before") + F.sum("size").over(within) + F.col("epoch") * F.col("source_size")
    rows = rows.withColumn("__end", end)
    begin = F.col("__end") - F.col("size")
    inner = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - begin))
    rows = rows.withColumn("start", F.coalesce(F.try_divide(begin, F.col("target")), F.lit(0.0))).withColumn("finish", F.coalesce(F.try_divide(F.col("__end"), F.col("target")), F.lit(0.0)))
    return rows.withColumn("inner", inner.cast("long")).drop("__g", "__before", "__end", "__source", "__null", "docs", "weight")


def cut_at_budget(times: DataFrame, budget: DataFrame) -> DataFrame:
    """The pieces of ``virtual_times`` with ``taken``: their words that the total budget (one row) pays for, in global order of finish times."""
    first = F.struct(F.least("finish", F.lit(1.0)).alias("at"), F.lit(0).alias("late"), F.col("inner").alias("words"))
    last = F.struct(F.col("finish").alias("at"), F.lit(1).alias("late"), (F.col("size") - F.col("inner")).alias("words"))
    pieces = F.when(F.col("inner") == F.col("size"), F.array(first)).when(F.col("inner") == 0, F.array(last)).otherwise(F.array(first, last))
    order = ["at", "late", "doc_id", "epoch", "row"]
    rows = materialize(times.select("*", F.inline(pieces)).drop("inner"), "pieces")
    rows = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "in-ranges")
    # one row per range partition: small
    ahead = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__part").agg(F.sum("words").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, "__part").withColumn("__end", F.col("__before") + F.sum("words").over(within)).crossJoin(F.broadcast(budget))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - (F.col("__end") - F.col("words"))))
    return rows.withColumn("taken", taken.cast("long")).drop("__part", "__before", "__end", "budget", "words", "at", "late")


def mix_order(times: DataFrame) -> DataFrame:
    """The mix itself: what is taken, range-sorted by virtual finish time over the whole cluster."""
    return times.where(F.col("taken") > 0).repartitionByRange("finish", "doc_id", "epoch", "row").sortWithinPartitions("finish", "doc_id", "epoch", "row")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, epochs, first_finish``, in the order of first_finish.

    Null texts have size 0 and are never taken; a null source is a source of its own,
    named last. Repeated rows are documents of their own. An empty table gives an empty one. Other
    columns of the input are ignored, whatever their names.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("th"))
    return mix_sized(sized, weights, max_epochs)


def mix_sized(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``mix_sources`` for rows ``(doc_id, source, size)``."""
    times = mix_times(sized, weights, max_epochs)
    per = times.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("taken").alias("taken"), F.count_if(F.col("taken") > 0).alias("epochs"), F.min("finish").alias("first_finish"),
    )
    return per.orderBy("first_finish", "doc_id", "row").drop("row")


def mix_times(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``virtual_times`` of rows ``(doc_id, source, size, ...)``, each with a number ``row`` that tells repeated rows apart, cut at the budget."""
    return numbered_times(materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sizes"), weights, max_epochs)


def numbered_times(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``mix_times`` for rows that have their number already."""
    targets = materialize(source_targets(sized, weights, max_epochs), "targets")
    budget = targets.agg(F.coalesce(F.sum(F.floor("target").cast("long")), F.lit(0)).alias("budget"))
    return cut_at_budget(virtual_times(sized, targets, max_epochs), budget)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed rows of ``docs`` in the order of the mix: as often as it takes them, whole; one that the cut crosses stays if it is taken by half.

    Rows come range-sorted by finish time: the partitions, and the files written from them, follow each other.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("th"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    times = numbered_times(rows.select("doc_id", "source", "size", "th", "row"), weights, max_epochs)
    taken = materialize(times.where((F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size"))).select("row", "doc_id", "epoch", "finish", "taken"), "taken")
    return mix_order(taken.join(rows.select("row", "__row"), "row")).select("__row.*")
