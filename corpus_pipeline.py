"""From raw documents to packed training sequences, stage by stage.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. None is
expressible in SQL as a whole (trained models, an iterated graph, a
tokenizer), so there is no oracle; the tests check each stage on small tables.

Columns beside doc_id, text and lang pass through whatever their names. A null
or empty text is scored as an empty one by the quality classifier and dropped
by language ID (it has no letter); texts without words are nobody's duplicates;
repeated rows are duplicates of each other; rows with a null id pass like others
and come last where an order of ids matters; an empty table gives an empty one.

The stages share their executors, and their plans run after they have returned,
so a stage with Python workers leaves the session with small batches for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerecs.llm import decontaminate, jaccard, langid, packing, quality
from pagerecs.llm.common import held_out, keep, set_apart, small_batches, table
from pagerecs.session import prepare

#: Share of the predicted language from which on a text counts as in a language.
LEAST_LANGUAGE = 0.4
#: Chunks that a worker remembers while packing: its executor has run four stages before.
PACKING_CACHE = 300_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what attention-based multiple-instance learning rejects (operator 5)."""
    small_batches(spark)
    docs, named = set_apart(docs, "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    training = docs.where(~held_out(F.col("doc_id"), 0)).join(labels, "doc_id")
    return named(quality.score(docs, quality.fit(training)).where("predicted = 1"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or without a clear language (operator 3)."""
    small_batches(spark)
    docs, named = set_apart(docs, "doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 0)))
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)
    return named(langid.identify(docs, model).where(kept))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the n-gram Jaccard join (operator 6)."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a near duplicate of a benchmark item (operator 9)."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences (operator 1)."""
    return packing.pack(docs, cache=PACKING_CACHE).placement.drop("row_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
