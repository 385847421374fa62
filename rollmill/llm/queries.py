"""The queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, embeddings, linededup, mixing, packing, pieces, pii, quality, simhash, substring, tokencount, toxicity, trie
from .common import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 with at most three epochs."""
    out = mixing.mix_sources(documents(spark, sf_dir))
    return out.withColumn("target", F.round("target", 6)).withColumn("first_finish", F.round("first_finish", 9))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents, at most three differing bits."""
    return simhash.simhash_groups(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated three-line windows: what went and a digest of what is left."""
    out = linededup.dedup_lines(documents(spark, sf_dir))
    kept = F.coalesce("kept_text", F.lit(""))
    return out.select("__row.doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.md5(kept.cast("binary")).alias("kept_md5"))


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents and whether they exceed 2048."""
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and risk-controlled quality verdicts of all documents, by language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_verdicts(documents(spark, sf_dir), labels)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that occur twice: what went and a digest of what is left."""
    return substring.remove_repeats(documents(spark, sf_dir))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all embeddings with a cosine of 0.93 or more, within labels."""
    return embeddings.embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, by a model fitted on labelled ones that are not held out."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    out = pii.replace_pii(documents(spark, sf_dir))
    return out.select("__row.doc_id", F.col("safe_text").alias("text"), "n_entities")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers on all documents, and how their links stand in the corpus's pair counts."""
    scores, _ = align.align_and_score(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return scores


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt from their families' bases."""
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with a piece vocabulary and decoded again: number and digest of the ids, digest of the decoded text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(documents(spark, sf_dir), path), path)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_linededup": op4_linededup,
    "op5_tokencount": op5_tokencount,
    "op6_quality": op6_quality,
    "op7_substring": op7_substring,
    "op8_embeddings": op8_embeddings,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_align": op11_align,
    "op12_trie": op12_trie,
    "op13_pieces": op13_pieces,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH s AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM s GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
l AS (SELECT *, (total - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS lv FROM l),
g AS (SELECT source, source_size, least(coalesce(lv * w, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM t),
e AS (SELECT s.*, source_size, target, unnest(range(0, CAST(greatest(1, least(3, coalesce(ceil(target / nullif(source_size, 0)), 1))) AS BIGINT))) AS epoch FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, epoch ORDER BY md5(doc_id || ':' || epoch)) AS BIGINT) + epoch * source_size AS fin FROM e),
k AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - (fin - size))) AS took FROM o)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(sum(took) AS BIGINT) AS taken, count(*) FILTER (WHERE took > 0) AS epochs, round(coalesce(min(fin / nullif(target, 0)), 0), 9) AS first_finish
FROM k GROUP BY doc_id, size, source_size, target
"""

_TRIMMED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_OP4 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
nb AS (SELECT doc_id, i, {_TRIMMED} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE {_TRIMMED} <> ''),
w AS (SELECT doc_id, k, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS win FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT win, min(struct_pack(d := doc_id, k := k)) AS first FROM w WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
later AS (SELECT w.doc_id, CASE WHEN w.doc_id = first.d THEN greatest(w.k, first.k + 3) ELSE w.k END AS lo, w.k + 3 AS hi FROM w JOIN f USING (win) WHERE NOT (w.doc_id = first.d AND w.k = first.k)),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi)) AS k FROM later),
st AS (SELECT nb.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed FROM nb LEFT JOIN gone ON nb.doc_id = gone.doc_id AND nb.k = gone.k GROUP BY nb.doc_id),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS body FROM l LEFT JOIN nb ON l.doc_id = nb.doc_id AND l.i = nb.i LEFT JOIN gone ON nb.doc_id = gone.doc_id AND nb.k = gone.k WHERE gone.k IS NULL GROUP BY l.doc_id),
done AS (SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN coalesce(n_removed, 0) = 0 THEN coalesce(text, '') WHEN n_removed = n_lines THEN '' ELSE coalesce(body, '') END AS body
    FROM documents d LEFT JOIN st ON d.doc_id = st.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(body) AS BIGINT) AS kept_chars, md5(body) AS kept_md5 FROM done
"""

_LADDER = ", ".join(str(c) for c in quality.CUTOFFS)


def _steps(share: str) -> str:
    """SQL for the number of cutoffs that lie below a share."""
    return f"len(list_filter([{_LADDER}]::DOUBLE[], lambda o: o < {share}))"


_OP6 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM documents),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d))),
rep AS (SELECT doc_id, sum(least(8, gap)) AS n FROM (SELECT doc_id, p - lag(p, 1, -8) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM win WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
t AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_steps("n_symbols / greatest(word_chars, 1)")} AS a, {_steps("n_dup_lines / greatest(n_lines, 1)")} AS b, {_steps("n_repeat_words / greatest(n_words, 1)")} AS c FROM m),
y AS (SELECT doc_id, bool_or(quality = 1) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT lang, a, b, c, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS w FROM t JOIN y USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
n AS (SELECT lang, CAST(sum(g) AS BIGINT) AS n_good, CAST(sum(w) AS BIGINT) AS n_bad, count(*) OVER () AS strata FROM h GROUP BY lang HAVING sum(g) > 0),
s AS (SELECT unnest(range(0, {len(quality.CUTOFFS) + 1})) AS i),
grid AS (SELECT n.lang AS lang, n_good, n_bad, strata, x.i AS a, y.i AS b, z.i AS c FROM n, s AS x, s AS y, s AS z),
v AS (SELECT grid.*, n_good - coalesce(p.g, 0) AS k, n_bad - coalesce(p.w, 0) AS bad FROM grid, LATERAL (SELECT CAST(sum(g) AS BIGINT) AS g, CAST(sum(w) AS BIGINT) AS w FROM h WHERE h.lang IS NOT DISTINCT FROM grid.lang AND h.a <= grid.a AND h.b <= grid.b AND h.c <= grid.c) AS p),
q AS (SELECT *, CASE WHEN k >= n_good * {quality.RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({quality.RISK}) + (n_good - i) * ln(1 - {quality.RISK})))) END AS tail FROM v),
best AS (SELECT lang, min(struct_pack(o := -bad, k := k, a := a, b := b, c := c)) AS pick FROM q WHERE tail <= {quality.DELTA} / (strata * {(len(quality.CUTOFFS) + 1) ** len(quality.RULES) - 1}) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(t.a > pick.a OR t.b > pick.b OR t.c > pick.c, false) AS kept
FROM t LEFT JOIN best ON t.lang IS NOT DISTINCT FROM best.lang
"""

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
_OP12 = f"""
WITH t AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS b, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, b, {_CRC.format("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c, b FROM t)),
own AS (SELECT k.c, 1 AS part, t.i, r, x FROM k JOIN t ON t.c = k.c AND t.i > k.h UNION ALL SELECT k.c, 0, t.i, r, x FROM k JOIN t ON t.c = k.b AND t.i <= k.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, md5(len(r) || ':' || r || x) AS m, len(x) AS size FROM own),
p AS (SELECT c, d, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d)) AS key, size FROM n UNION ALL SELECT c, 0, '', 0 FROM k),
g AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS w FROM p GROUP BY d, key),
up AS (SELECT DISTINCT p.d, p.key, o.key AS above FROM p JOIN p AS o ON o.c = p.c AND o.d = p.d - 1),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM up GROUP BY d, above),
e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
z AS (SELECT p.d, p.key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM p JOIN e USING (c, d) GROUP BY p.d, p.key),
own_w AS (SELECT p.c, p.d, g.w, CASE WHEN kids.key IS NULL THEN 1 ELSE 0 END AS leaf FROM p JOIN g ON g.d = p.d AND g.key = p.key AND g.conv_id = p.c LEFT JOIN kids ON kids.d = p.d AND kids.key = p.key),
s AS (SELECT p.d, p.key, sum(own_w.w) AS saved, sum(leaf) AS leaves FROM p JOIN own_w ON own_w.c = p.c AND own_w.d >= p.d GROUP BY p.d, p.key)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM g JOIN s ON s.d = g.d AND s.key = g.key LEFT JOIN kids ON kids.d = g.d AND kids.key = g.key LEFT JOIN z ON z.d = g.d AND z.key = g.key LEFT JOIN up ON up.d = g.d AND up.key = g.key LEFT JOIN g AS o ON o.d = g.d - 1 AND o.key = up.above
"""

#: The others are beyond SQL (hash functions, tokenizers, fitted models, connected components); tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_mixing": _OP1, "op4_linededup": _OP4, "op6_quality": _OP6, "op12_trie": _OP12}
