"""Document coverage and scenario lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.functions import text as X

# Document sections that must be present and filled.
REQUIRED_SECTIONS = ("职责", "行为意图", "行为", "约束", "输入输出", "调用链位置", "状态与副作用", "异常处理", "与 PRD 需求映射", "溯源证据")
# Step lint patterns.
IMPL_DETAIL = r"\b(Repo|Ecto|Schema|Changeset)\b|\bfrom\(|(?i:\b(insert_all|update_all|transaction|rollback|SQL)\b)"
ORDER_WORDS = r"(?i)(^|\s)(index=|first\b|last\b)"
INTERACTION = r"(?i)\b(mock|spy|stub|called|invoked)\b"
STRONG = ("A", "B", "C", "D", "error")
DEGRADED = {"determination_contract": "determination_degraded_pass", "reactor_contract": "reactor_degraded_pass"}
SEED_STEP = "then_seed_contract_should_hold"
UNIQUE_ARGS = (("given", "create_product", "product_id"), ("given", "create_order_item", "product_id"))


def document_coverage(sources: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """One row: sources with and without a document."""
    marked = sources.select(key).join(docs.select(key).distinct().withColumn("d", F.lit(1)), key, "left")
    return marked.agg(
        F.count("*").alias("total_files"), F.count("d").alias("with_docs"), F.count_if(F.col("d").isNull()).alias("missing_docs")
    )


def missing_documents(sources: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    return sources.select(key).join(docs.select(key), key, "left_anti")


def section_gaps(docs: DataFrame, sections=REQUIRED_SECTIONS) -> DataFrame:
    """(doc, section, state) for absent or empty required sections."""
    states = F.array(*[F.struct(F.lit(s).alias("section"), X.section_state(F.col("text"), s).alias("state")) for s in sections])
    return docs.select("doc", F.explode(F.filter(states, lambda s: s["state"] != "ok")).alias("g")).select("doc", "g.*")


def quality_reasons(docs: DataFrame) -> DataFrame:
    """(doc, reasons) of incomplete scenario texts."""
    return docs.select("doc", F.array_join(X.scenario_quality(F.col("text")), "; ").alias("reasons")).filter("reasons <> ''")


def quality_report(docs: DataFrame) -> DataFrame:
    bad = F.size(X.scenario_quality(F.col("text"))) > 0
    return docs.agg(F.count("*").alias("total_files"), F.count_if(bad).alias("invalid_files"))


def scenarios_per_module(docs: DataFrame) -> DataFrame:
    """(module, files, scenarios) plus a total row under a null module."""
    return docs.rollup("module").agg(
        F.count("*").alias("files"), F.sum(F.regexp_count("text", F.lit(r"\[SCENARIO:"))).cast("bigint").alias("scenarios")
    )


def duplicate_ids(scenarios: DataFrame) -> DataFrame:
    """(id, doc, line, first_doc, first_line): later places of a scenario id with its first place.

    An aggregate finds the first place of repeated ids; rows of a hot id are not gathered.
    """
    first = scenarios.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc", "line")).alias("f")).filter("n > 1")
    joined = scenarios.join(first, "id").filter((F.col("doc") != F.col("f.doc")) | (F.col("line") != F.col("f.line")))
    return joined.select("id", "doc", "line", F.col("f.doc").alias("first_doc"), F.col("f.line").alias("first_line"))


def uncovered_instructions(steps: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Instructions used but not in capabilities(name), with their first use."""
    return (
        steps.join(capabilities.select("name"), "name", "left_anti")
        .groupBy("name")
        .agg(F.min(F.struct("doc", "line")).alias("f"))
        .select("name", F.col("f.doc").alias("doc"), F.col("f.line").alias("line"))
    )


def match_contracts(scenarios: DataFrame, contracts: DataFrame) -> DataFrame:
    """Seed contract by scenario id, else by the part after ``-SEED-``."""
    own = contracts.select(F.col("contract_id").alias("id"), F.struct(*contracts.columns).alias("own"))
    bare = contracts.select(F.col("contract_id").alias("bare"), F.struct(*contracts.columns).alias("by_bare"))
    tail = F.nullif(F.regexp_extract("id", r"-SEED-(.*)$", 1), F.lit(""))
    return (
        scenarios.withColumn("bare", tail).join(own, "id", "left").join(bare, "bare", "left")
        .withColumn("contract", F.coalesce("own", "by_bare")).drop("own", "by_bare", "bare")
    )


def _sufficient() -> Column:
    flow = F.col("contract.edge_class") == "workflow_contract"
    steps, hints, facts = F.col("contract.action_steps"), F.col("contract.branch_hints"), F.col("contract.facts")
    return F.when(flow, (steps >= 2) | (hints > 0)).otherwise((facts > 0) | (steps > 0) | (hints > 0))


def _expected_weak() -> Column:
    return (F.col("contract.edge_class") == "workflow_contract") & (F.col("contract.action_steps") == 1) & (F.col("contract.branch_hints") == 0)


COUNTS = ("thens", "weak_thens", "strong_thens", "async_acts", "eventually", "snapshots", "seed_thens", "io_asserts", "interactions")


def _step_counts() -> list[Column]:
    """What the lint counts over the steps of a scenario, joined with the instructions; headers count as nothing."""
    then, when = F.col("kind") == "then", F.col("kind") == "when"
    strong = F.coalesce(F.col("assert_class").isin(*STRONG), F.lit(False))
    weak = F.col("assert_class").isNull() | (F.col("assert_class") == "weak")
    tests = (
        then,
        then & weak,
        then & strong,
        when & F.coalesce("is_async", F.lit(False)),
        then & F.coalesce("is_eventually", F.lit(False)),
        then & (F.col("name") == "assert_http_snapshot"),
        then & (F.col("name") == SEED_STEP),
        then & (F.col("assert_class") == "D") & (F.col("boundary") == "external_io"),
        then & F.col("raw").rlike(INTERACTION),
    )
    return [F.count_if(test).alias(name) for name, test in zip(COUNTS, tests)]


def scenario_lint(scenarios: DataFrame, steps: DataFrame, instructions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(doc, segment, id, rule): structure and assertion rules, one aggregate over all steps.

    Scenarios without any step are included; an unknown instruction counts as weak.
    """
    facts = steps.join(instructions.drop("kind"), "name", "left").groupBy("doc", "segment").agg(*_step_counts())
    return _lint(scenarios.join(facts, ["doc", "segment"], "left").fillna(0, list(COUNTS)), contracts).drop("tags")


def lint_rows(rows: DataFrame, instructions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(doc, segment, id, tags, rule): :func:`scenario_lint` of ``documents.scenario_rows``, each line read once.

    A scenario's header and its step counts are one aggregate, so scenarios and steps are never joined.
    """
    known = rows.join(instructions.drop("kind"), "name", "left")
    # id and tags are keys, so that only counters are aggregated: by hash, without a sort of the rows
    return _lint(known.groupBy("doc", "segment", F.col("scenario.id").alias("id"), F.col("scenario.tags").alias("tags")).agg(*_step_counts()), contracts)


def _lint(counted: DataFrame, contracts: DataFrame) -> DataFrame:
    rows = match_contracts(counted, contracts)
    tag = lambda t: F.array_contains("tags", t)
    seeded = (F.col("seed_thens") > 0) & F.col("contract").isNotNull()
    excused = seeded & (F.coalesce(_sufficient(), F.lit(False)) | F.coalesce(_expected_weak(), F.lit(False)))
    rules = [
        ("missing_then", F.col("thens") == 0),
        ("weak_assertion", (F.col("thens") > 0) & (F.col("weak_thens") == F.col("thens")) & ~excused),
        ("insufficient_evidence", tag("strict_evidence") & (F.col("strong_thens") == 0)),
        ("async_without_eventually", (F.col("async_acts") > 0) & (F.col("eventually") == 0)),
        ("pure_snapshot", tag("strict_snapshot") & (F.col("snapshots") > 0) & (F.col("snapshots") == F.col("thens"))),
        (
            "over_interaction_assertion",
            tag("strict_interaction") & ~tag("e2e") & ~tag("allow_interaction_assert") & (F.col("io_asserts") == 0) & (F.col("interactions") > 0),
        ),
    ] + [(rule, seeded & (F.col("contract.edge_class") == edge)) for edge, rule in DEGRADED.items()]
    hits = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules]))
    return rows.select("doc", "segment", "id", "tags", F.explode(hits).alias("rule"))


def step_lint(steps: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(doc, line, rule) per step: sleeps, order dependence, implementation details, constant ids."""
    return _step_lint(steps.join(scenarios.select("doc", "segment", "tags"), ["doc", "segment"]))


def step_lint_rows(rows: DataFrame) -> DataFrame:
    """:func:`step_lint` of ``documents.scenario_rows``: a step carries the tags of its scenario, so nothing is joined."""
    return _step_lint(rows.filter(~F.col("is_header")).withColumn("tags", F.col("scenario.tags")))


def _step_lint(tagged: DataFrame) -> DataFrame:
    raw = F.col("raw")
    constant = F.lit(False)
    for kind, name, arg in UNIQUE_ARGS:
        v = F.col("args")[arg]
        fresh = v.contains("bdd_run_") | v.contains("run_id") | v.contains("#{")
        constant = constant | ((F.col("kind") == kind) & (F.col("name") == name) & v.isNotNull() & ~fresh)
    rules = [
        ("sleep_anti_pattern", F.lower(raw).contains("sleep")),
        ("order_dependence", raw.rlike(ORDER_WORDS)),
        ("impl_detail_reference", raw.rlike(IMPL_DETAIL)),
        ("unique_risk", F.array_contains("tags", "strict_unique") & constant),
    ]
    hits = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules]))
    return tagged.select("doc", "line", F.explode(hits).alias("rule"))


def _in_suites() -> Column:
    return F.array_contains("tags", "integration") | F.array_contains("tags", "e2e")


def _tests_failure() -> Column:
    return ((F.col("kind") == "then") & (F.col("name") == "assert_last_error")) | ((F.col("kind") == "when") & F.startswith("name", F.lit("try_")))


def negative_coverage(scenarios: DataFrame, steps: DataFrame, suite: str) -> DataFrame:
    """Suites with integration or e2e scenarios of which none tests a failure."""
    marks = steps.groupBy("doc", "segment").agg(F.bool_or(_tests_failure()).alias("negative"))
    return _without_negatives(scenarios.filter(_in_suites()).join(marks, ["doc", "segment"], "left"), suite)


def negative_rows(rows: DataFrame, suites: DataFrame, suite: str) -> DataFrame:
    """:func:`negative_coverage` of ``documents.scenario_rows`` and suites(doc, <suite>)."""
    marked = rows.withColumn("tags", F.col("scenario.tags")).filter(_in_suites()).groupBy("doc", "segment").agg(F.bool_or(_tests_failure()).alias("negative"))
    return _without_negatives(marked.join(suites, "doc"), suite)


def negative_blocks(blocks: DataFrame, suites: DataFrame, suite: str) -> DataFrame:
    """:func:`negative_coverage` of ``documents.scenario_blocks``: a scenario is judged inside its row, its texts meet no shuffle."""
    failing = F.exists("steps", lambda s: s["text"].rlike(r"^(THEN\s+assert_last_error(\s|$)|WHEN\s+try_)"))
    marked = blocks.filter(_in_suites()).select("doc", failing.alias("negative"))
    return _without_negatives(marked.join(suites, "doc"), suite)


def _without_negatives(marked: DataFrame, suite: str) -> DataFrame:
    return marked.groupBy(suite).agg(F.count("*").alias("scenarios"), F.count_if("negative").alias("negatives")).filter("negatives = 0")


def _gate_hit(tags: list[str] | None, globs: list[str] | None) -> Column:
    if not tags and not globs:
        return F.lit(True)
    hit = F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])) if tags else F.lit(False)
    return P.any_of([hit, *[F.regexp_like("file", P.glob_regex(F.lit(g))) for g in globs or []]])


def warning_gate(warnings: DataFrame, tags: list[str] | None = None, globs: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """One row ``fails``: any warning, or only those whose tags or file match."""
    if not enabled:
        return warnings.agg(F.count("*").alias("warnings")).select("warnings", F.lit(False).alias("fails"))
    return warning_gates(warnings, {"fails": (tags, globs)})


def warning_gates(warnings: DataFrame, gates: dict[str, tuple[list[str] | None, list[str] | None]]) -> DataFrame:
    """One row with a column for each gate name -> (tags, globs), all from one pass over the warnings."""
    fails = [F.coalesce(F.bool_or(_gate_hit(*gate)), F.lit(False)).alias(name) for name, gate in gates.items()]
    return warnings.agg(F.count("*").alias("warnings"), *fails)
