"""Queries that apply the corpus operators to whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, licenses, neardup, quality, recount, threads, topk, toxicity
from .common import remainder, stash, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = langid.fit(docs.where(~held).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.positions").alias("positions"), F.col("language.agreement").alias("agreement"))


def bpe_digests(coded: DataFrame, into: str = "bpe", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    return coded.select(
        *keep,
        F.expr(f"cast(octet_length({into}.ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2(f"{into}.ids", 256).alias("ids_sha256"),
        F.sha2(F.col(f"{into}.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER))


def op3_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.format_threads(table(spark, sf_dir, "conversations"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


OP4_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per match; documents without one have none."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses.found").alias("m")).select("doc_id", "m.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), by_question=True)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", F.round("l.score", 6).alias("score"), "l.overlap", "l.question_overlap", "l.answer_overlap")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


def op8_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after a fixed script of three edits, from kept trees."""
    trees = stash(recount.index(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER), "trees", "zstd")
    found = recount.recount(trees.withColumn("edits", recount.sample_edits(F.col("text"))), "edits", TOKENIZER, tree="tree", keep=["doc_id"], new_tree=False)
    return found.select("doc_id", F.col("recount.before").alias("n_tokens"), F.col("recount.after").alias("n_tokens_after"), F.col("recount.encoded_chars").alias("encoded_chars"), F.sha2(F.col("recount.edited").cast("binary"), 256).alias("edited_sha256"))


def _scored(spark: SparkSession, sf_dir: str, kind, label_col: str, threshold: float) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 5) == 0
    model = kind.fit(labels.where(~held).select("doc_id", label_col), docs.select("doc_id", "text"))
    found = kind.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("result.score").alias("score"), (F.col("result.score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 0.3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 0.5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_threads": threads.SQL, "op4_topk": OP4_SQL}
