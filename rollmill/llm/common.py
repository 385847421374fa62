"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (a local session, as in tests) a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(shared_dir, "local", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="rollmill-")
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage durably (a lost executor costs no recomputation of what came
    before) and gives the planner the true size, so that a small table is broadcast
    below ``spark.sql.autoBroadcastJoinThreshold`` and joined by sort-merge above it.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rollmill-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a join leaves to one task, and slots of the table that tells frequent keys apart.
KEY_ROWS, SLOTS = 8192, 1 << 18


def keyed_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, deal: tuple[str, ...]) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, a table of one row per key whose column ``n`` counts the rows of the key.

    Rows of a key with over ``KEY_ROWS`` are dealt out (by a hash of ``deal``) to as many parts as it takes, and the key's row goes to each
    part. Which keys these are is told by a table of at most ``SLOTS`` rows, broadcast; keys that share a slot with one are dealt out as well.
    """
    slot = F.pmod(F.xxhash64(*on, F.lit("slot")), F.lit(SLOTS)).alias("__slot")
    hot = keys.where(F.col(n) > KEY_ROWS).groupBy(slot).agg(F.ceil(F.max(n) / KEY_ROWS).cast("int").alias("__parts"))
    hot = F.broadcast(materialize(hot, "hot"))
    left = rows.withColumn("__slot", slot).join(hot, "__slot", "left").drop("__slot")
    left = left.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*deal), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    right = keys.withColumn("__slot", slot).join(hot, "__slot", "left").drop("__slot")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*on, "__part"]).drop("__part")


#: Bits of the filter that keeps untouched texts out of a shuffle: at most 2 MB, whatever the data.
FILTER_BITS = 1 << 24


def _cut(batches, at: int, flagged: bytes, inside: bool):
    bits = np.frombuffer(flagged, np.uint8)
    for batch in batches:
        key = batch.column(at).to_numpy().view(np.uint64) % np.uint64(8 * len(bits))
        hit = (bits[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        yield batch.filter(pa.array(hit == inside))


def hash_filter(wanted: DataFrame):
    """A filter for rows by their column ``th``, from the hashes ``th`` of ``wanted``: ``(rows, inside) -> rows``.

    With ``inside`` the rows of those hashes and some more pass, else only rows of other hashes; each row passes in one of both ways.
    """
    bit = F.col("th").bitwiseAND(F.lit(FILTER_BITS - 1))
    found = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("m")).toPandas()
    flags = np.zeros(FILTER_BITS // 32, np.uint32)
    flags[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64).astype(np.uint32)
    data = flags.astype("<u4").tobytes()

    def passing(rows: DataFrame, inside: bool = True) -> DataFrame:
        at = rows.columns.index("th")
        return rows.mapInArrow(lambda it: _cut(it, at, data, inside), rows.schema)

    return passing


def with_hash_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose ``th`` is among those of ``wanted``, and some more."""
    return hash_filter(wanted)(rows)


def small(batches, rows: int = 512):
    """Arrow batches cut to so many rows, so that what is made of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(text: Column) -> Column:
    """Array of the ASCII-white-space separated words of a text (null or blank: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
