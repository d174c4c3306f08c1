"""The operators' registered queries, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, html_extract, langid, mixing, permuterm, pii, quality_classifier, quality_rules,
               setsketch, similarity_join, url_filter, whitening)
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model).select("doc_id", "quality.*")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    scores = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "url_verdict.*")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    leak = F.col("leak")
    return found.select("doc_id", leak["n_words"].alias("n_words"), leak["n_hit"].alias("n_hit"),
                        F.size(leak["items"]).cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", leak["items"]), 256).alias("items_sha256"),
                        (leak["n_hit"] > 0).alias("contaminated"))


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = chat_format.format_conversations(rows.unionByName(extra))
    return chats.select("conv_id", chat_format.read_back("chat").alias("d")).select("conv_id", "d.*").drop("n_tokens")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_join.linked(docs).select("doc_id", "n_shingles", "component_id")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("langid.lang").alias("lang_pred"),
                        F.col("langid.score").alias("score"))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", F.col("main_text").alias("text"),
                                              F.length("main_text").cast("long").alias("n_chars"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    p = F.col("pii")
    return found.select("doc_id", *[p[c].alias(c) for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.group_spellings(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    white = whitening.whiten(rows, model)
    explained = F.array(*map(F.lit, model.explained.tolist())) if model else F.lit(None).cast("array<double>")
    out = white.select("vec_id", "white.deviation", F.posexplode("white.whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
                      "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
                      F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))


@query
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return setsketch.linked(docs).select("doc_id", "n_shingles", "component_id", "kept")
