"""Line dedup over overlapping windows of three lines.

Windows slide over a document's lines that hold a word (lines are compared without white space at their
ends). A window that occurs more than once in the corpus keeps its first occurrence, in order of
doc_id and line; every later one is removed: the lines its windows cover are merged and dropped.
A later window that overlaps its own first occurrence removes only what lies beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, keyed_join, materialize

LINES = 3


def _trim(x):
    return F.btrim(x, F.lit(ASCII_SPACE))


def _with_lines(rows: DataFrame) -> DataFrame:
    """Adds ``__lines`` and ``__at``, the places of those lines that hold a word."""
    rows = rows.withColumn("__lines", F.split(F.coalesce("__text", F.lit("")), "\n"))
    return rows.withColumn("__at", F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: _trim(F.col("__lines")[i]) != ""))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__row, __id, __text, __th``: a document is told by its id and the hash of its text."""
    return docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.col(text_col)).alias("__th"))


def windows(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """``(__id, __th, k, h1, h2)``: the hashes (96 bits) of the window that starts at the k-th line with a word."""
    rows = _with_lines(rows.select("__id", "__th", "__text"))
    rows = rows.withColumn("__x", F.transform("__at", lambda i: F.xxhash64(_trim(F.col("__lines")[i]))))
    rows = rows.withColumn("__y", F.transform("__at", lambda i: F.hash(_trim(F.col("__lines")[i]))))
    last = F.size("__at") - lines
    of = lambda arr, k, f: f(*[F.col(arr)[k + j] for j in range(lines)])
    made = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.struct(of("__x", k, F.xxhash64).alias("h1"), of("__y", k, F.hash).alias("h2"))))
    return rows.select("__id", "__th", F.posexplode(made).alias("k", "w")).select("__id", "__th", "k", "w.h1", "w.h2")


def removals(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """``(__id, __th, cover)``: per document the line ranges [lo, hi) to remove, in places among the lines with a word."""
    w = materialize(windows(rows, lines), "windows")
    firsts = w.groupBy("h1", "h2").agg(F.min(F.struct("__id", "k", "__th")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a window that many documents hold is joined in parts
    later = keyed_join(w, materialize(firsts, "firsts"), ["h1", "h2"], "n", ("__id", "__th", "k")).where(F.struct("__id", "k", "__th") != F.col("first"))
    own = F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__th") == F.col("first.__th"))
    lo = F.when(own, F.greatest(F.col("k"), F.col("first.k") + lines)).otherwise(F.col("k"))
    # a document's ranges are no more than its lines
    return later.select("__id", "__th", lo.alias("lo"), (F.col("k") + lines).alias("hi")).groupBy("__id", "__th").agg(F.collect_set(F.struct("lo", "hi")).alias("cover"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """The rows of ``docs`` as ``__row`` with ``n_lines, n_removed`` and ``kept_text``.

    Null texts stay null; texts of fewer than three lines with a word stay as they are; a text that
    loses all such lines becomes empty. Rows that repeat id and text get the same result (none
    is removed for the other's sake); a null id sorts first.
    """
    rows = _keyed(docs, id_col, text_col)
    cover = removals(rows, lines).select(F.col("__id").alias("__cid"), F.col("__th").alias("__cth"), "cover")
    rows = rows.join(cover, F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__th") == F.col("__cth")), "left")
    rows = _with_lines(rows)
    gone = F.array_distinct(F.flatten(F.transform("cover", lambda c: F.when(c["lo"] < c["hi"], F.sequence(c["lo"], c["hi"] - 1)).otherwise(F.array().cast("array<int>")))))
    rows = rows.withColumn("__gone", F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.transform("__gone", lambda k: F.col("__at")[k]))
    text = F.when(F.size("__gone") == 0, F.col("__text")).when(F.size("__gone") == F.size("__at"), F.lit("")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n"))
    return rows.select("__row", F.size("__at").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"), text.alias("kept_text"))
