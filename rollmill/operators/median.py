"""Exact medians of groups of any size: no task ever holds the values of a group.

A histogram of each large group tells in which bin its middle values lie; only these values go on to a finer histogram, until few are left. Bins keep the
order of values, so counts are all that is needed of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder
from ..spec import MetricTable, seconds

#: Values of a group that are sorted in one place, and bins of a histogram.
FEW, BINS = 10_000, 1024


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: each round reads what the last one left."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _middle(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From ``keys, v, low, high``: the mean of the values of rank low and high (from 0) among a group's few values."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1
    ranked = rows.withColumn("rank", rank)
    pick = lambda c: F.max(F.when(F.col("rank") == F.col(c), F.col("v")))
    return ranked.groupBy(*keys).agg((0.5 * pick("low") + 0.5 * pick("high")).alias("m"))


def exact_median(df: DataFrame, mt: MetricTable, window: int | str, tags=(), fields=("*",), few: int = FEW, bins: int = BINS) -> DataFrame:
    """``bucket``, tags and ``median_<field>`` per window and tags, equal to the built-in median.

    Groups of at most ``few`` values are aggregated at once. For larger ones a sketch first bounds the middle, then histograms of ``bins`` bins narrow it, a
    pass each over what is left; values outside are only counted. Groups with NaN or infinite values go the built-in way. Runs jobs.
    """
    tags, fields = list(tags), mt.chosen(fields)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields]))
    rows = df.select(F.window(mt.time, f"{seconds(window)} seconds")["start"].alias("bucket"), *tags, cells.alias("c")).select("bucket", *tags, "c.field", "c.v")
    keys = ["bucket", *tags, "field"]
    odd = F.coalesce(F.isnan("v") | (F.abs("v") == float("inf")), F.lit(False))
    sketch = F.percentile_approx("v", [0.49, 0.51], 1000)  # off by a thousandth of the values at most
    sizes = _written(rows.groupBy(*keys).agg(F.count("v").alias("n"), F.bool_or(odd).alias("odd"), sketch.alias("q")), "group-sizes")
    large = sizes.where((F.col("n") > few) & ~F.col("odd"))
    named = [F.col(k).alias(f"__{k}") for k in keys]

    def at(left: DataFrame, right: DataFrame) -> DataFrame:
        """An inner join by keys of which some may be null; ``right`` has one row per key."""
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return left.join(right, on).drop(*[f"__{k}" for k in keys])

    n_large = large.count()
    if not n_large:
        found = rows.groupBy(*keys).agg(F.median("v").alias("m"))
    else:
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        small = rows.join(large.select(*named), on, "left_anti").groupBy(*keys).agg(F.median("v").alias("m"))
        target = large.select(*named, F.floor((F.col("n") - 1) / 2).alias("low"), F.floor(F.col("n") / 2).alias("high"), F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
        left, done = rows.where(F.col("v").isNotNull()), [small]
        while True:
            joined = at(left, target)
            width = F.col("b") / 2 - F.col("a") / 2
            place = F.when(F.col("v") < F.col("a"), -1).when(F.col("v") > F.col("b"), bins).when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("a") / 2) / width * bins), F.lit(bins - 1))).otherwise(0)
            binned = joined.withColumn("bin", place.cast("int"))
            counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("low").alias("low"), F.first("high").alias("high"))
            upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))  # at most bins + 2 rows a group
            counts = counts.withColumn("upto", upto)
            hit = (F.col("upto") > F.col("low")) & (F.col("upto") - F.col("n") <= F.col("high"))
            bounds = counts.where(hit).groupBy(*keys).agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.min(F.col("upto") - F.col("n")).alias("below"), F.sum("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
            bounds = _written(bounds.select(*keys, "a", "b", "n", (F.col("low") - F.col("below")).alias("low"), (F.col("high") - F.col("below")).alias("high")), "bounds")
            # one value left, however often
            done.append(bounds.where("a = b").select(*keys, F.col("a").alias("m")))
            open_ = bounds.where("a < b").select(*named, "a", "b", "n", "low", "high")
            within = at(left, open_).where(F.col("v").between(F.col("a"), F.col("b")))
            left = _written(within, "values")
            done.append(_middle(left.where(F.col("n") <= few).select(*keys, "v", "low", "high"), keys))
            target = open_.where(F.col("n") > few).select(*[f"__{k}" for k in keys], "low", "high", "a", "b")
            if target.isEmpty():
                break
            left = left.where(F.col("n") > few).select(*keys, "v")
        found = done[0]
        for part in done[1:]:
            found = found.unionByName(part)
    return found.groupBy("bucket", *tags).agg(*[F.max(F.when(F.col("field") == f, F.col("m"))).alias(f"median_{f}") for f in fields])
