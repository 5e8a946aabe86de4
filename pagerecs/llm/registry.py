"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerecs.llm import (
    bitslice,
    chat,
    decontaminate,
    divergence,
    flat,
    jaccard,
    langid,
    packing,
    quality,
    runs,
    seekable,
    suffix_tree,
    toxicity,
)
from pagerecs.llm.common import held_out, keep, table
from pagerecs.sources.storage import fresh_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).placement.drop("row_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    seekable.write_token_files(table(spark, sf_dir, "documents"), path)
    rows = keep(seekable.read_token_files(spark, path, with_ids=False).drop("ids"), "token-rows")
    return seekable.with_start(rows).select("doc_id", "start", "n_tokens", "ids_crc32", "file_part", "file_number")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "flat-files")
    flat.write_flat(table(spark, sf_dir, "documents"), path)
    found = flat.scan_flat(spark, path, head_ids=flat.HEAD_IDS)
    return found.select(
        flat.head_doc_id(F.col("head")).alias("doc_id"), (F.col("n_tokens") - flat.HEAD_IDS).alias("n_tokens")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 0))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 0))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    return quality.score(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("text_hash", "stays")


#: The fixed conversation that op7 formats beside the table's: its texts hold the template's own marks.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], given.schema)
    return chat.read_back(chat.format_conversations(given.unionByName(odd)))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 1))
    return suffix_tree.score(docs)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), altered=runs.periodic_copy)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 0))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    return toxicity.score(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_chat_format": op7_chat_format,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
}

#: The values of all pairs and the greatest terms, straight from the definition.
DIVERGENCE_SQL = """
WITH given AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS text
  FROM documents
), occurrences AS (
  SELECT row_id, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM given
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n
  FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), counted AS (
  SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n
  FROM occurrences o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, o.source, o.term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM given) g
  LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
         1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), values_found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(v.value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
  ) v ON v.lang = g.lang AND v.source = g.source AND v.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM values_found
)
WHERE part = 'pair' OR rank <= 10
"""

#: All inner products of queries and other rows; the given components' products are exact as doubles.
TOP_K_SQL = """
WITH given AS (
  SELECT row_number() OVER () AS row_id, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), scored AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM given q JOIN given c ON q.row_id <> c.row_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

#: All pairs of sets that share a shingle, and what they reach.
JACCARD_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN generate_series(1, len(words) - 4)]) END AS s
  FROM worded
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reached GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id
FROM sets s LEFT JOIN least l ON s.doc_id = l.a
"""

ORACLES: dict[str, str] = {
    "op6_jaccard_join": JACCARD_SQL,
    "op8_exact_top_k": TOP_K_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
