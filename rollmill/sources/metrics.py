"""Reading metric tables and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import MetricTable

RECORDS = "array<struct<time:timestamp_ntz,value:double,field:string,series:string>>"
DOCUMENT = f"array<struct<columns:array<string>,records:{RECORDS}>>"


def read_metrics(spark: SparkSession, path: str, mt: MetricTable, fmt: str = "parquet", derive: dict | None = None) -> DataFrame:
    """Time, tags (as strings), fields (as doubles) and ties of a table; the reader prunes the rest.

    ``derive`` gives columns that the table does not hold, by name.
    """
    df = spark.read.format(fmt).load(path)
    for name, column in (derive or {}).items():
        df = df.withColumn(name, column)
    mt.check(df)
    return df.select(
        mt.time, *[F.col(t).cast("string").alias(t) for t in mt.tags], *[F.col(f).cast("double").alias(f) for f in mt.fields],
        *[c for c in mt.ties if c not in (mt.time, *mt.tags, *mt.fields)],
    )


def flatten_series_docs(df: DataFrame, col: str = "doc", schema: str = DOCUMENT) -> DataFrame:
    """Nested result documents (JSON: tables with columns and records) as one row per record, with the table's number."""
    tables = df.select(*[c for c in df.columns if c != col], F.posexplode(F.from_json(col, schema)).alias("table_no", "t"))
    rows = tables.select(*[c for c in tables.columns if c != "t"], F.explode("t.records").alias("r"))
    return rows.select(*[c for c in rows.columns if c != "r"], "r.*")


def json_records(df: DataFrame) -> DataFrame:
    """Each row as a JSON record."""
    return df.select(F.to_json(F.struct("*")).alias("record"))


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_points(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
