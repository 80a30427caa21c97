"""Commit grading, tagging, issue links and spec organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.functions import text as X
from edgeloom.operators.ordering import positions

MAX_MERGED, HALF = 4000, 2000


def inventory(commits: DataFrame, files: DataFrame, lang: str, grades: list[str] | None = None) -> DataFrame:
    """Commits that touch a backend file, with total lines, grade, module of the first file and tags.

    commits(hash, message, author, date), files(hash, line_no, path, add, del).
    """
    per = files.groupBy("hash").agg(
        F.sum(F.col("add") + F.col("del")).alias("total_lines"),
        F.min_by("path", "line_no").alias("first_path"),
        F.bool_or(P.is_backend(F.col("path"), lang)).alias("backend"),
    )
    rows = commits.join(per.filter("backend"), "hash").select(
        "hash", "message", "author", "date", "total_lines", X.size_grade(F.col("total_lines")).alias("grade"),
        P.module_from_path(F.col("first_path")).alias("module"), F.array_join(X.tags(F.col("message")), ",").alias("tags"),
    )
    return rows.filter(F.col("grade").isin(*grades)) if grades else rows


def grade_counts(inv: DataFrame) -> DataFrame:
    return inv.groupBy("grade").agg(F.count("*").alias("commits"))


def newest(inv: DataFrame, n: int) -> DataFrame:
    return inv.orderBy(F.desc("date"), "hash").limit(n)


def ranked(inv: DataFrame) -> DataFrame:
    """All commits with their ``place`` from 1, the newest first, then by hash. No task sees all rows."""
    return positions(inv, [], [F.desc("date"), "hash"], "place")


def link_issues(commits: DataFrame, issues: DataFrame) -> DataFrame:
    """First ``#n`` of each message joined to issues(issue, title, body)."""
    first = F.try_element_at(X.commit_refs(F.col("message")), F.lit(1))
    return commits.withColumn("issue", first).join(issues, "issue", "left")


def merge_bodies(pairs: DataFrame) -> DataFrame:
    """(number, title, body): issue and pull request text under two headings, halved when over 4000 bytes.

    pairs(number, title, body, pr, pr_body). The headings are fixed values.
    """
    cut = lambda c: F.when(F.length(c) <= HALF, F.col(c)).otherwise(F.concat(F.substring(c, 1, HALF), F.lit("...(truncated)")))
    text = lambda a, b: F.concat(F.lit("## 原始需求\n"), a, F.lit("\n\n## 实现方案 (PR #"), F.col("pr").cast("string"), F.lit(")\n"), b)
    whole = text(F.col("body"), F.col("pr_body"))
    return pairs.select(
        "number",
        F.concat("title", F.lit(" (PR #"), F.col("pr").cast("string"), F.lit(")")).alias("title"),
        F.when(F.octet_length(whole) > MAX_MERGED, text(cut("body"), cut("pr_body"))).otherwise(whole).alias("body"),
    )


def spec_modules(specs: DataFrame, inv: DataFrame) -> DataFrame:
    """specs(hash, module, skip) with the module filled from the inventory: full hash, then 6-character prefix, then unknown."""
    full = inv.select("hash", F.col("module").alias("by_hash"))
    short = inv.groupBy(F.substring("hash", 1, 6).alias("short")).agg(F.min("module").alias("by_short"))
    own = F.nullif("module", F.lit(""))
    return (
        specs.withColumn("short", F.substring("hash", 1, 6)).join(full, "hash", "left").join(short, "short", "left")
        .select("hash", F.coalesce(own, "by_hash", "by_short", F.lit("unknown")).alias("module"), "skip")
    )


def specs_per_module(resolved: DataFrame) -> DataFrame:
    """(module, specs, skipped) plus the total row under a null module."""
    return resolved.rollup("module").agg(F.count_if(~F.col("skip")).alias("specs"), F.count_if("skip").alias("skipped"))


def stale(artifacts: DataFrame, inv: DataFrame) -> DataFrame:
    """Artifacts whose hash left the inventory."""
    return artifacts.join(inv.select("hash"), "hash", "left_anti")
