"""Evidence reduction, verdicts and order-dependent Bayesian folds.

Lists of evidence ids stay rows: a conclusion may own a third of all evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.ordering import positions

# Evidence weights and verdict thresholds.
BOND_WEIGHTS = {"deduction": 1.0, "verification": 0.7, "exploration": 0.3}
ACT_THRESHOLD = 0.7
PRIOR = 0.5
FOLD_ROWS = 4096


def weight(bond: Column) -> Column:
    out = F.lit(1.0)
    for name, w in BOND_WEIGHTS.items():
        out = F.when(bond == name, F.lit(w)).otherwise(out)
    return out


def valid(evidence: DataFrame) -> DataFrame:
    return evidence.filter("confidence >= 0 AND confidence <= 1")


def rejected(evidence: DataFrame) -> DataFrame:
    return evidence.filter("confidence IS NULL OR NOT (confidence >= 0 AND confidence <= 1)").select("evidence_id", "conclusion_id", "confidence")


def reduce(evidence: DataFrame, act: float = ACT_THRESHOLD) -> DataFrame:
    """(conclusion_id, supports, conflicts, confidence, verdict); below ``act`` every one-sided conclusion is to be investigated."""
    w = weight(F.col("bond_type"))
    effective = F.col("confidence") * w
    pro, con = F.col("relation") == "supports", F.col("relation") == "conflicts"
    sums = valid(evidence).groupBy("conclusion_id").agg(
        F.count_if(pro).alias("supports"),
        F.count_if(con).alias("conflicts"),
        F.sum(F.when(pro, effective).otherwise(-effective)).alias("drift"),
        F.sum(w).alias("total_weight"),
    )
    raw = F.when(F.col("total_weight") == 0, 0.5).otherwise(0.5 + F.col("drift") / (2 * F.col("total_weight")))
    confidence = F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 9)
    return sums.select("conclusion_id", "supports", "conflicts", confidence.alias("confidence")).withColumn(
        "verdict",
        F.when((F.col("supports") > 0) & (F.col("conflicts") > 0), "contested")
        .when(F.col("confidence") >= act, "act")
        .otherwise("investigate"),
    )


def evidence_lists(evidence: DataFrame) -> DataFrame:
    """(conclusion_id, relation, evidence_id): the id lists of every conclusion, as rows."""
    return valid(evidence).select("conclusion_id", "relation", "evidence_id")


def conflict_pairs(evidence: DataFrame) -> DataFrame:
    """Conflicting evidence in product form.

    Each evidence of a contested conclusion comes with how many partners it
    conflicts with and the first of them; the full pair list is the product of
    a conclusion's two sides and would grow with the square of a hot group.
    """
    rows = valid(evidence).select("conclusion_id", "evidence_id", "relation")
    sides = rows.groupBy("conclusion_id").agg(
        F.count_if(F.col("relation") == "supports").alias("n_pro"),
        F.count_if(F.col("relation") == "conflicts").alias("n_con"),
        F.min(F.when(F.col("relation") == "supports", F.col("evidence_id"))).alias("first_pro"),
        F.min(F.when(F.col("relation") == "conflicts", F.col("evidence_id"))).alias("first_con"),
    )
    pro = F.col("relation") == "supports"
    return rows.join(sides.filter("n_pro > 0 AND n_con > 0"), "conclusion_id").select(
        "conclusion_id",
        "relation",
        "evidence_id",
        F.when(pro, F.col("n_con")).otherwise(F.col("n_pro")).alias("partners"),
        F.when(pro, F.col("first_con")).otherwise(F.col("first_pro")).alias("first_partner"),
    )


def verdict_counts(conclusions: DataFrame) -> DataFrame:
    return conclusions.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in ("act", "investigate", "contested")],
    )


def _order() -> list:
    rank = F.when(F.col("verdict") == "contested", 0).when(F.col("verdict") == "investigate", 1).otherwise(2)
    return [rank, "confidence", "conclusion_id"]


def ordered(conclusions: DataFrame) -> DataFrame:
    """Contested first, then investigate, then act; then confidence and id."""
    return conclusions.orderBy(*_order())


def ranked(conclusions: DataFrame) -> DataFrame:
    """The same order as a column ``place`` from 1. No task sees all rows."""
    return positions(conclusions, [], _order(), "place")


def posterior(evidence: DataFrame, seq: str = "seq", start: float = PRIOR, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(conclusion_id, posterior, evidence_count, verdict), evidence folded in ``seq`` order.

    In log odds one update is "clamp to [-L, L], then add w", and chains of such
    steps are again "add s, clamp to [lo, hi]". So a long history folds as a tree:
    blocks of ``fold_rows`` consecutive sequence numbers first, then blocks of
    blocks. No task ever holds more than one block of a conclusion.
    """
    limit = F.log(F.lit(0.99) / F.lit(0.01))
    effective = F.least(F.greatest(F.col("confidence") * weight(F.col("bond_type")), F.lit(0.0)), F.lit(1.0))
    sign = F.when(F.col("relation") == "supports", 1.0).otherwise(-1.0)
    likelihood = F.least(F.greatest(0.5 + sign * effective / 2, F.lit(0.01)), F.lit(0.99))
    w = F.log(likelihood / (1 - likelihood))
    low, high = evidence.agg(F.min(seq), F.max(seq)).first()
    low, top = low or 0, (high or 0) - (low or 0)
    steps = valid(evidence).select(
        "conclusion_id", (F.col(seq) - low).alias("seq"), w.alias("s"), (w - limit).alias("lo"), (w + limit).alias("hi"), F.lit(1).cast("bigint").alias("n")
    )
    clamp = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)

    def merge(acc: Column, nxt: Column) -> Column:
        return F.struct(
            (acc["s"] + nxt["s"]).alias("s"),
            clamp(acc["lo"] + nxt["s"], nxt["lo"], nxt["hi"]).alias("lo"),
            clamp(acc["hi"] + nxt["s"], nxt["lo"], nxt["hi"]).alias("hi"),
        )

    inf = F.lit(float("inf"))
    same = F.struct(F.lit(0.0).alias("s"), (-inf).alias("lo"), inf.alias("hi"))
    while True:
        folded = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "s", "lo", "hi"))), same, merge)
        steps = (
            steps.groupBy("conclusion_id", F.floor(F.col("seq") / fold_rows).cast("bigint").alias("block"))
            .agg(folded.alias("f"), F.sum("n").alias("n"))
            .select("conclusion_id", F.col("block").alias("seq"), "f.s", "f.lo", "f.hi", "n")
        )
        top //= fold_rows
        if top == 0:
            break
    x = clamp(F.log(F.lit(start) / F.lit(1 - start)) + F.col("s"), F.col("lo"), F.col("hi"))
    p = F.round(1 / (1 + F.exp(-x)), 9)
    return steps.select("conclusion_id", p.alias("posterior"), F.col("n").alias("evidence_count")).withColumn(
        "verdict", F.when(F.col("posterior") >= ACT_THRESHOLD, "act").otherwise("investigate")
    )
