"""Health score: one row per dimension, weighted total per mode, recommendations, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight and blocking flag per dimension.
DIMENSIONS = {
    "compliance": (0.30, True),
    "density": (0.25, True),
    "layering": (0.25, True),
    "acyclic": (0.10, True),
    "coverage": (0.10, False),
    "code_quality": (0.10, True),
}
UNEXPECTED_PENALTY, FORBIDDEN_PENALTY = 1.5, 2.0
DENSITY_IDEAL_MIN, DENSITY_IDEAL_MAX, DENSITY_MAX = 10.0, 40.0, 75.0
PASS_THRESHOLD = 60.0


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def _dimension(name: str, score: Column, passed: Column) -> list[Column]:
    weight, blocking = DIMENSIONS[name]
    return [
        F.lit(name).alias("dimension"),
        F.lit(weight).alias("weight"),
        score.cast("double").alias("score"),
        passed.alias("passed"),
        F.lit(blocking).alias("blocking"),
    ]


def compliance(scenario: DataFrame) -> DataFrame:
    m, u, f = F.col("matched_edges_count"), F.col("unexpected_edges_count"), F.col("forbidden_edges_count")
    total = m + u * UNEXPECTED_PENALTY + f * FORBIDDEN_PENALTY
    score = F.when(total > 0, F.least(m / total * 100, F.lit(100.0))).otherwise(100.0)
    return scenario.select(*_dimension("compliance", score, (u == 0) & (f == 0)))


def density(structure: DataFrame) -> DataFrame:
    d = F.col("directed_density_pct")
    score = (
        F.when((d >= DENSITY_IDEAL_MIN) & (d <= DENSITY_IDEAL_MAX), 100.0)
        .when(d < DENSITY_IDEAL_MIN, 60 + d / DENSITY_IDEAL_MIN * 40)
        .when(d < DENSITY_MAX, 100 - (d - DENSITY_IDEAL_MAX) / (DENSITY_MAX - DENSITY_IDEAL_MAX) * 100)
        .otherwise(0.0)
    )
    return structure.select(*_dimension("density", score, d <= DENSITY_MAX))


def layering(checked: DataFrame) -> DataFrame:
    """From layer_violations rows; skipped rows are not dependencies."""
    counts = checked.agg(
        F.count_if(F.col("verdict") != "skipped").alias("deps"), F.count_if(F.col("verdict") == "violation").alias("bad")
    )
    score = F.when(F.col("deps") > 0, (F.col("deps") - F.col("bad")) / F.col("deps") * 100).otherwise(100.0)
    return counts.select(*_dimension("layering", score, F.col("bad") == 0))


def acyclic(structure: DataFrame, max_pairs: int = 0) -> DataFrame:
    pairs = F.col("bidirectional_pair_count")
    return structure.select(*_dimension("acyclic", 100 - F.least(pairs * 10.0, F.lit(100.0)), pairs <= max_pairs))


def contract_ratio(modules: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row ``contract``: the share of modules(module_id) that some contract(caller, callee) names; 0 without modules."""
    named = contracts.select(F.explode(F.array("caller", "callee")).alias("module_id")).distinct().withColumn("named", F.lit(True))
    marked = modules.select("module_id").distinct().join(named, "module_id", "left")
    return marked.agg(F.coalesce(F.count("named") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("contract"))


def coverage(ratios: DataFrame) -> DataFrame:
    """From one row of bdd and contract ratios in [0, 1]."""
    b, c = F.col("bdd"), F.col("contract")
    return ratios.select(*_dimension("coverage", (b * 0.4 + c * 0.6) * 100, (b >= 0.6) & (c >= 0.6)))


def code_quality(findings: DataFrame) -> DataFrame:
    counts = findings.agg(
        F.count_if(F.col("severity") == "critical").alias("c"),
        F.count_if(F.col("severity") == "error").alias("e"),
        F.count_if(F.col("severity") == "warning").alias("w"),
    )
    score = F.greatest(100.0 - F.col("c") * 20 - F.col("e") * 10 - F.col("w") * 2, F.lit(0.0))
    return counts.select(*_dimension("code_quality", score, (score >= PASS_THRESHOLD) & (F.col("c") == 0)))


def dimensions(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def total(dims: DataFrame, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """(mode, raw, total, grade, blocking_failures, passed) for strict, lenient and warning mode."""
    sums = dims.agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("raw"),
        F.count_if(F.col("blocking") & ~F.col("passed")).alias("blocking_failures"),
    )
    raw, bad = F.col("raw"), F.col("blocking_failures")
    modes = sums.select("*", F.explode(F.array(F.lit("strict"), F.lit("lenient"), F.lit("warning"))).alias("mode"))
    final = (
        F.when((F.col("mode") == "strict") & (bad > 0), 0.0)
        .when(F.col("mode") == "lenient", F.greatest(raw - bad * 20.0, F.lit(0.0)))
        .otherwise(raw)
    )
    t = F.col("total")
    ok = (
        F.when(F.col("mode") == "strict", (bad == 0) & (t >= threshold))
        .when(F.col("mode") == "lenient", t >= threshold)
        .otherwise(True)
    )
    return modes.withColumn("total", final).select("mode", "raw", "total", grade(t).alias("grade"), "blocking_failures", ok.alias("passed"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issue totals over dimensions; issues(dimension, severity, location)."""
    return issues.agg(
        F.count("*").alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in ("critical", "error", "warning", "info")],
    )


def recommendations(dims: DataFrame, issues: DataFrame, top: int = 5, locations: int = 5) -> DataFrame:
    """Dimensions with issues: blocking first, then low score; up to five locations as rows."""
    ranked = (
        dims.join(issues.select("dimension").distinct(), "dimension", "left_semi")
        .withColumn("urgency", F.when(F.col("blocking"), 1000.0).otherwise(0.0) - F.col("score"))
        .orderBy(F.desc("urgency"), "dimension")
        .limit(top)
        .select(
            "dimension",
            "score",
            F.when(F.col("blocking") & (F.col("score") < 60), "high").when(F.col("score") < 60, "medium").otherwise("low").alias("priority"),
        )
    )
    from pyspark.sql import Window

    w = Window.partitionBy("dimension").orderBy("location")
    first = issues.filter("location IS NOT NULL").select("dimension", "location").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= locations)
    return ranked.join(first, "dimension", "left")


def compare(scores: DataFrame, versions: list[str]) -> DataFrame:
    """dimension x version table of scores(version, dimension, score)."""
    if len(versions) < 2:
        raise ValueError("compare needs two versions or more")
    return scores.groupBy("dimension").pivot("version", versions).agg(F.first("score"))
