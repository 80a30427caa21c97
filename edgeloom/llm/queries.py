"""The registered queries of this subpackage and, where SQL can say it, the check beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import (
    collision_ann, decontaminate, grouped_packing, line_templates, packing, prefix_trie, rules_quality, secret_scan, set_join, substrings, surrogates, term_pipeline, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_line_templates", line_templates.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=35, keep_text=False)


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op5_length_buckets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_text=False)


@query("op6_rule_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rules_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = rules_quality.score_documents(docs.select("doc_id", "text"), model, threshold=0.3)
    return scored.select("doc_id", rules_quality.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("hits")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs)).drop("secrets")


@query("op2_private_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(table(spark, sf_dir, "documents"), key="registered query")


@query("op4_collision_ann")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op7_simhash_decontamination", decontaminate.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_prefix_trie", prefix_trie.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations")))


@query("op12_grouped_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return grouped_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_term_pipeline", term_pipeline.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository, beside the registry

    return corpus_pipeline.run(spark, sf_dir)
