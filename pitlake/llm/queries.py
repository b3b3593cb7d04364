"""Registered queries over the text tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import conversations, decontaminate, hard_negatives, html_text, jaccard, line_dedup, packing, pii, quality, sharding, token_counts, topk, toxicity
from pitlake.llm.oracle import ORACLES  # noqa: F401

QUERIES: dict = {}
#: Folder of public tokenizer files, the same on every machine.
TOKENIZERS = str(Path(public_tokenizers.path("word_bpe_49k.json")).parent)


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_jaccard_join(spark, folder):
    return jaccard.jaccard_join(table(spark, folder, "documents"))


@query
def op4_decontaminate(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op10_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


@query
def op3_line_dedup(spark, folder):
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op2_quality(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"))


@query
def op8_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


@query
def op6_pii(spark, folder):
    return pii.personal_data(table(spark, folder, "documents")).withColumn("base_sha256", F.sha2("base", 256)).drop("base")


@query
def op7_html_text(spark, folder):
    return html_text.main_text(table(spark, folder, "pages"))


@query
def op11_hard_negatives(spark, folder):
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


@query
def op13_sharding(spark, folder):
    return sharding.shard(table(spark, folder, "documents"))


@query
def op12_conversation_repair(spark, folder):
    return conversations.report(table(spark, folder, "conversations"), damage=True)
