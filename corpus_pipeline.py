"""From raw documents to packed training batches: five stages, each written and read again before the next.

Each stage takes any columns beside doc_id and text, whatever their names, and an empty table, which stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, line_templates, packing, rules_quality, set_join
from edgeloom.session import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alone(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` on doc_id, text and one struct of all other columns, so that no name of theirs meets one of its own."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed_up = F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("__row")
    done = operator(docs.select("doc_id", "text", packed_up))
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__row").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score of 0.3 or more); null and empty texts are scored as texts without
    words, repeated rows are judged alike. Without labels the score is 0.5 and all stay."""
    model = rules_quality.train(docs, _table(spark, sf_dir, "labels"))
    return _alone(docs, lambda d: rules_quality.score_documents(d, model, threshold=0.3).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur; n_chars, where there is one, follows the text. A null text
    comes back empty; repeated rows lose the same lines."""
    kept = _alone(docs, line_templates.drop_recurring_lines)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more: the least doc_id, a null
    one last, of repeated rows one. Null, empty and blank texts are linked with nothing and all stay."""
    return _alone(docs, lambda d: set_join.keep_one_of_each(d, words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null, empty and very short texts hold none, repeated rows go or
    stay together. Without items all stay."""
    return _alone(docs, lambda d: decontaminate.drop_contaminated(d, _table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 words in length buckets and batches of 16384 words; see ``packing.pack``. Null and empty
    texts are one piece without a place; repeated rows are pieces of their own. Only doc_id and text are read."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]
# The quality model is trained, which SQL can't express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
