"""A corpus pipeline: stages that each take the documents kept so far and return those they keep.

Language identification drops texts of no language, exact and near copies are reduced to one document each, the
sources are mixed to their target weights, and what is left is encoded. Each stage works on all rows of the one
before, which are written to the shared folder and read again.

Null texts have no language and go in the first stage. Rows without doc_id pass all stages as any others, but aren't
looked at as near copies; rows that share a doc_id stay or go together there, and have counts of their own in the mix.
Columns of documents besides doc_id, text, lang and source pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from tidemark.llm.shared import documents, unused_name, written
from tidemark.session import bounded_batches

#: A text whose profile is at less than this likeness from all languages' is in none of them.
LEAST_LIKENESS = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; profiles are learned from those with a language."""
    bounded_batches(spark)
    profiles = language_id.learn(docs)
    lang, score = unused_name(docs, "lang_pred"), unused_name(docs, "score")
    found = language_id.predict(docs, profiles, out=(lang, score))
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LIKENESS)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    bounded_batches(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, a similarity of 0.8 or more."""
    bounded_batches(spark)
    found = ngram_join.similar_components(docs, ngram_join.Join(width=5, percent=80))
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.repeated(docs, weights=(5, 2, 1), budget=1.5, cap=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and whether they decode to its text."""
    bounded_batches(spark)
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("same"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_to_weights),
    ("BPE encoding", encode),
]

#: SQL can't express the first and the last stage; a test holds all of them against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stage's rows written and read again before the next one."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
