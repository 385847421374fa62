"""The stages of the corpus pipeline: each applies one operator's decisions to whole documents.

The columns of the input pass through whatever their names: a row travels as one struct.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, mixing, neardup, packing, quality, simhash
from .common import hash_filter, keyed_join, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Cutoffs come from the labelled ones among those that are left."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id"), F.col("lang").alias("stratum"), F.col("text"))
    stats = quality.measured(rows)
    cutoffs = quality.cutoff_table(stats.drop("__row", "text", "__task"), labels)
    return quality.verdicts(stats, cutoffs).where("kept AND __task >= 0").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows the text that is left."""
    out = linededup.dedup_lines(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("__row.n_chars"))}
    return out.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def _first_of_groups(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The row with the smallest id of every ``root`` of ``grouped (doc_id, th, root)``.

    Groups are decided on ids and hashes of texts; only texts whose hash may be in a group of several rows are shuffled.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th"))
    several = materialize(grouped.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    members = keyed_join(grouped, several, ["root"], "n", ("th", "doc_id"))
    gone = members.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).select("doc_id", "th").distinct()
    keyed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))
    passing = hash_filter(members)
    gone = gone.select(F.col("doc_id").alias("__gid"), F.col("th").alias("__gth"))
    near = passing(keyed).join(gone, F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("th") == F.col("__gth")), "left_anti")
    return near.dropDuplicates(["__id", "th"]).select("__row.*").unionByName(passing(keyed, inside=False).select("__row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of op2 (fingerprints of three-word shingles within 3 bits) the document with the smallest id stays."""
    own = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    fps = materialize(simhash.fingerprints(own, ("doc_id", "th")), "fingerprints")
    return _first_of_groups(docs, fps.join(simhash.classes(fps), "fp"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return _first_of_groups(docs, neardup.near_copies(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight 5, 2, 1; a source that is short of its target is repeated, up to three times in all."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_copies), ("mixing", mix), ("packing", pack)]
