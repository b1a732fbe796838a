"""Corpus pipeline: language, toxicity, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``; the last returns them too and adds token counts and digests of ids and decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, langid, neardup, toxicity
from tessella.llm.common import fresh, remainder, stash, table, unstash
from tessella.llm.queries import TOKENIZER, bpe_digests

#: A document stays if its language's pooled probability is at least this many times an even split over all
#: languages (0.3 with four of them); texts without letters always go.
LEAST_OVER_EVEN = 1.2
#: A document goes if it is toxic with at least this probability.
TOXIC = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language cannot be told from an even split. Without any labelled row, all go."""
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    into = fresh(docs, "_language")
    least = LEAST_OVER_EVEN / max(1, len(model.languages)) if len(model.languages) > 1 else 0.0
    found = langid.identify(docs, model, into=into)
    return found.where((F.col(f"{into}.lang_pred") != langid.UNKNOWN) & (F.col(f"{into}.score") >= least)).drop(into)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score ``TOXIC`` or more. Texts without words score the prior; without labels of both kinds that is all a score says."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = toxicity.fit(labels.select("doc_id", "toxic"), docs.select("doc_id", "text"))
    into = fresh(docs, "_toxicity")
    return toxicity.score(docs, model, into=into).where(F.col(f"{into}.score") < TOXIC).drop(into)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of exact and near copies; texts without words are no copies."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or its question. Null texts hold nothing and stay."""
    into = fresh(docs, "_leaks")
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), into=into, by_question=True).where(F.size(into) == 0).drop(into)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the number of tokens and digests of ids and decoded text. A null text has no tokens."""
    into = fresh(docs, "_bpe")
    return bpe_digests(bpe.round_trip(docs, TOKENIZER, into=into), into, docs.columns)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("tokens", encode),
]

#: Trained models cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        unstash(before)
    return STAGES[-1][1](spark, docs, sf_dir)
