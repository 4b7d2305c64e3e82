"""A training corpus from ``documents``: five stages, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm import language_id
from subledger.llm.common import written
from subledger.llm.exact_dedup import exact_dedup, normalised
from subledger.llm.jaccard_join import jaccard_components
from subledger.llm.quality_rules import quality_rules
from subledger.llm.queries import packed

#: A document's largest language must have this share of its words.
LANGUAGE_SHARE = 0.5
#: Near copies share this percentage of their shingles of so many words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the struct ``record``, where no name can clash with one of ours."""
    return rows.select(*(F.col("record")[c].alias(c) for c in docs.columns))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that the rules remove; ``n_chars`` follows the text.

    Null, empty and short texts go. Equal texts of a host count as one document for its lines, since the copies go only in a later stage; repeated rows stay or go together. Other columns are carried.
    """
    rows = docs.select(F.struct("*").alias("record"), "text", "source", "n_chars")
    ruled = quality_rules(rows).where("rules.kept")
    size = F.when(F.col("rules.removed_chars") > 0, F.char_length("rules.text").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("rules.text"), "n_chars": size}
    return ruled.select(*(new.get(c, F.col("record")[c]).alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that can be told, and one that most of their words are in; learned from the stage's own input.

    Null texts and texts without a letter go; a null ``lang`` is not learned from. Equal texts stay or go together. Other columns are carried.
    """
    model = language_id.fit(docs)
    found = language_id.identify(docs.select(F.struct("*").alias("record"), "text"), model, ["record"])
    return _restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)), docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, null ids last; a null text counts as empty. Of rows that repeat id and text one stays. Other columns are carried."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    marked = docs.select(F.struct("*").alias("record"), F.col("doc_id").alias("own_id"), F.sha2(normalised(F.col("text")), 256).alias("own_sha"))
    rows = marked.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha")), "left_semi")
    return _restored(rows.dropDuplicates(["own_id", "own_sha"]), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; texts without a word are near none. Rows that share an id, or have none, stay or go together. Other columns are carried."""
    chosen = jaccard_components(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT).where("doc_id <=> component_id").select(F.col("doc_id").alias("chosen_id")).distinct()
    rows = docs.select(F.struct("*").alias("record"), F.col("doc_id").alias("own_id"))
    return _restored(rows.join(chosen, F.col("own_id").eqNullSafe(F.col("chosen_id")), "left_semi"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as sequences; a null or empty text is its end id alone. Each row is packed by itself; other columns play no part."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't tokenize or infer languages; tests/llm/test_pipeline.py has the expected ids of each stage, test_cleaned.py and test_near.py compare removed lines and near copies with plain Python.
ORACLE_SQL = None
