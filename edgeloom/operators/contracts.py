"""Allow/forbid contracts against actual relations: classes, gates, layers, flows, boundaries, events.

Contracts stay declarative. Parent inheritance and sibling defaults are applied
as key look-ups on the actual edges; the expanded pair tables, which grow with
the square of the children, are never built. Their counts come from arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.operators.relations import module_pairs
from edgeloom.session import Scratch

EDGE = ["caller", "callee"]

# Gate metrics in report order.
GATE_METRICS = (
    "unexpected_edges_count",
    "forbidden_edges_count",
    "forbidden_total_edges",
    "missing_edges_count",
    "directed_density_pct",
    "bidirectional_pair_count",
)


def edge_set(*tables: DataFrame) -> DataFrame:
    """Distinct (caller, callee) of one or more contract tables."""
    out = tables[0].select(*EDGE)
    for t in tables[1:]:
        out = out.union(t.select(*EDGE))
    return out.distinct()


def edge_classes(relations: DataFrame, allow: DataFrame, forbid: DataFrame) -> DataFrame:
    """Relations with ``class`` forbidden / matched / unexpected; forbid beats allow."""
    marks = (
        edge_set(allow).withColumn("a", F.lit(True)).join(edge_set(forbid).withColumn("f", F.lit(True)), EDGE, "full")
    )
    return relations.join(marks, EDGE, "left").select(
        *relations.columns,
        F.when(F.col("f"), "forbidden").when(F.col("a"), "matched").otherwise("unexpected").alias("class"),
    )


def missing_edges(relations: DataFrame, allow: DataFrame) -> DataFrame:
    """Allowed edges that do not occur."""
    return edge_set(allow).join(relations.select(*EDGE), EDGE, "left_anti")


def evaluate(name: str, relations: DataFrame, allow: DataFrame, forbid: DataFrame) -> DataFrame:
    """One row of counts and weights per scenario, from one full join of keys and edges."""
    keys = (
        edge_set(allow).withColumn("a", F.lit(True)).join(edge_set(forbid).withColumn("f", F.lit(True)), EDGE, "full")
    )
    weights = relations.select(*EDGE, F.col("total_edges").alias("w"))
    rows = keys.join(weights, EDGE, "full").select(
        "w",
        F.coalesce("a", F.lit(False)).alias("a"),
        F.coalesce("f", F.lit(False)).alias("f"),
    )
    seen = F.col("w").isNotNull()
    forbidden = seen & F.col("f")
    matched = seen & F.col("a") & ~F.col("f")
    unexpected = seen & ~F.col("a") & ~F.col("f")
    weigh = lambda test: F.coalesce(F.sum(F.when(test, F.col("w"))), F.lit(0))
    return rows.agg(
        F.count_if("a").alias("allow_count"),
        F.count_if("f").alias("forbid_count"),
        F.count_if(matched).alias("matched_edges_count"),
        weigh(matched).alias("matched_total_edges"),
        F.count_if(unexpected).alias("unexpected_edges_count"),
        weigh(unexpected).alias("unexpected_total_edges"),
        F.count_if(forbidden).alias("forbidden_edges_count"),
        weigh(forbidden).alias("forbidden_total_edges"),
        F.count_if(F.col("a") & ~seen).alias("missing_edges_count"),
    ).select(F.lit(name).alias("name"), "*")


def bidirectional_pairs(relations: DataFrame) -> DataFrame:
    """(a, b, ab, ba, total), each unordered pair once.

    Both directions meet under one ordered key, so a grouping does the work of a self join.
    """
    forward = F.col("caller") < F.col("callee")
    return (
        relations.filter("total_edges > 0 AND caller <> callee")
        .groupBy(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b"))
        .agg(
            F.sum(F.when(forward, F.col("total_edges"))).alias("ab"),
            F.sum(F.when(~forward, F.col("total_edges"))).alias("ba"),
        )
        .filter("ab IS NOT NULL AND ba IS NOT NULL")
        .withColumn("total", F.col("ab") + F.col("ba"))
    )


def top_pairs(relations: DataFrame, n: int = 10) -> DataFrame:
    return bidirectional_pairs(relations).orderBy(F.desc("total"), "a", "b").limit(n)


def structure(relations: DataFrame) -> DataFrame:
    """Module count, possible and actual edges, density, total weight, bidirectional pairs."""
    ends = relations.select(F.explode(F.array("caller", "callee")).alias("m")).distinct()
    n = F.col("modules_count")
    possible = n * (n - 1)
    density = F.when(possible == 0, 0.0).otherwise(F.round(F.col("directed_edges_actual") * 100.0 / possible, 2))
    one = lambda df: df.withColumn("_k", F.lit(1))
    counts = one(ends.agg(F.count("*").alias("modules_count")))
    edges = one(
        relations.agg(
            F.count("*").alias("directed_edges_actual"),
            F.coalesce(F.sum("total_edges"), F.lit(0)).alias("total_module_edge_weight"),
        )
    )
    pairs = one(bidirectional_pairs(relations).agg(F.count("*").alias("bidirectional_pair_count")))
    return (
        counts.join(edges, "_k")
        .join(pairs, "_k")
        .select(
            "modules_count",
            possible.alias("directed_edges_possible"),
            "directed_edges_actual",
            density.alias("directed_density_pct"),
            "total_module_edge_weight",
            "bidirectional_pair_count",
        )
    )


def gate_rows(scenarios: DataFrame, structure_row: DataFrame, limits: DataFrame) -> DataFrame:
    """(profile, metric, actual, limit, pass); ``scenarios.name`` is the profile."""
    both = scenarios.withColumn("_k", F.lit(1)).join(structure_row.withColumn("_k", F.lit(1)), "_k")
    long = both.select(
        F.col("name").alias("profile"),
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual")) for m in GATE_METRICS])
        ).alias("x"),
    ).select("profile", "x.metric", "x.actual")
    return long.join(limits, ["profile", "metric"]).select(
        "profile", "metric", "actual", F.col("limit").cast("bigint").alias("limit"), (F.col("actual") <= F.col("limit")).alias("pass")
    )


def gate_verdicts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("profile").agg(F.bool_and("pass").alias("pass"), F.count_if(~F.col("pass")).alias("failed"))


def top_by_class(classed: DataFrame, n: int = 20) -> DataFrame:
    """Heaviest n unexpected and forbidden edges (the rank filter is pushed below the shuffle)."""
    w = Window.partitionBy("class").orderBy(F.desc("total_edges"), *EDGE)
    return (
        classed.filter("class <> 'matched'")
        .select("class", *EDGE, "total_edges", F.row_number().over(w).alias("rank"))
        .filter(F.col("rank") <= n)
    )


def remediation(classed: DataFrame) -> DataFrame:
    """Forbidden edges become blocked work, unexpected edges temporary allowances."""
    return classed.filter("class <> 'matched'").select(
        F.when(F.col("class") == "forbidden", "blocked").otherwise("temporary_allow").alias("remedy"),
        *EDGE,
        "total_edges",
    )


def derive_contracts(relations: DataFrame, expected: DataFrame | None) -> DataFrame:
    """(caller, callee, contract): allow, forbid, blocked and temporary_allow rows.

    Without expectations every actual edge is allowed. With them, expectations
    split by flag; each forbid is also blocked; actual edges in neither are temporary.
    """
    if expected is None:
        return relations.select(*EDGE, F.lit("allow").alias("contract"))
    flagged = expected.groupBy(*EDGE).agg(F.bool_and("allowed").alias("allowed"))
    declared = flagged.select(
        *EDGE,
        F.explode(
            F.when(F.col("allowed"), F.array(F.lit("allow"))).otherwise(F.array(F.lit("forbid"), F.lit("blocked")))
        ).alias("contract"),
    )
    extra = relations.select(*EDGE).join(flagged, EDGE, "left_anti").withColumn("contract", F.lit("temporary_allow"))
    return declared.unionByName(extra)


def inherited_classes(relations: DataFrame, expected: DataFrame, modules: DataFrame) -> DataFrame:
    """Flag of each actual edge after one level of parent inheritance and sibling default.

    Order: the edge's own declaration, then an inherited forbid, then an inherited
    allow, then "siblings may call each other". Each step is a key look-up.
    """
    flags = expected.groupBy(*EDGE).agg(F.bool_and("allowed").alias("allowed"))
    parents = modules.select("module_id", "parent")
    base = (
        relations.select(*EDGE)
        .join(parents.toDF("caller", "caller_parent"), "caller", "left")
        .join(parents.toDF("callee", "callee_parent"), "callee", "left")
    )
    tries = base.select(
        *EDGE,
        (F.col("caller_parent") == F.col("callee_parent")).alias("siblings"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("k"), F.col("caller").alias("c"), F.col("callee").alias("d")),
                F.struct(F.lit(1).alias("k"), F.col("caller_parent").alias("c"), F.col("callee").alias("d")),
                F.struct(F.lit(1).alias("k"), F.col("caller").alias("c"), F.col("callee_parent").alias("d")),
                F.struct(F.lit(1).alias("k"), F.col("caller_parent").alias("c"), F.col("callee_parent").alias("d")),
            )
        ).alias("t"),
    ).select(*EDGE, "siblings", F.col("t.k").alias("k"), F.col("t.c").alias("c"), F.col("t.d").alias("d"))
    hits = tries.join(flags.toDF("c", "d", "allowed"), ["c", "d"], "left")
    own, inherited = F.col("k") == 0, F.col("k") == 1
    return (
        hits.groupBy(*EDGE)
        .agg(
            F.bool_or("siblings").alias("siblings"),
            F.bool_and(F.when(own, F.col("allowed"))).alias("own"),
            F.bool_and(F.when(inherited, F.col("allowed"))).alias("inherited"),
        )
        .select(
            *EDGE,
            F.when(F.col("own").isNotNull(), F.when(F.col("own"), "allow").otherwise("forbid"))
            .when(F.col("inherited").isNotNull(), F.when(F.col("inherited"), "inherited_allow").otherwise("inherited_forbid"))
            .when(F.col("siblings"), "sibling_allow")
            .otherwise("undeclared")
            .alias("contract"),
        )
    )


def expansion_counts(expected: DataFrame, modules: DataFrame) -> DataFrame:
    """How many edges each declared edge stands for once children inherit it."""
    kids = modules.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n"))
    return (
        expected.join(kids.toDF("caller", "caller_children"), "caller", "left")
        .join(kids.toDF("callee", "callee_children"), "callee", "left")
        .select(
            *EDGE,
            "allowed",
            (
                (F.coalesce("caller_children", F.lit(0)) + 1) * (F.coalesce("callee_children", F.lit(0)) + 1)
            ).alias("edges"),
        )
    )


def layer_violations(
    relations: DataFrame, layers: DataFrame, forbidden: DataFrame, allowed: DataFrame, precedence: DataFrame
) -> DataFrame:
    """Relations with ``verdict`` ok / violation / skipped.

    Same layer passes; explicit forbid, then explicit allow, then precedence
    (caller below callee passes); a layer without precedence passes.
    layers(module, layer), forbidden/allowed(from_layer, to_layer), precedence(layer, precedence).
    """
    pair = ["from_layer", "to_layer"]
    rows = (
        relations.select(*EDGE, "total_edges")
        .join(layers.toDF("caller", "from_layer"), "caller", "left")
        .join(layers.toDF("callee", "to_layer"), "callee", "left")
        .join(forbidden.select(*pair).distinct().withColumn("no", F.lit(True)), pair, "left")
        .join(allowed.select(*pair).distinct().withColumn("yes", F.lit(True)), pair, "left")
        .join(precedence.toDF("from_layer", "from_rank"), "from_layer", "left")
        .join(precedence.toDF("to_layer", "to_rank"), "to_layer", "left")
    )
    verdict = (
        F.when(F.col("from_layer").isNull() | F.col("to_layer").isNull(), "skipped")
        .when(F.col("from_layer") == F.col("to_layer"), "ok")
        .when(F.col("no"), "violation")
        .when(F.col("yes"), "ok")
        .when(F.col("from_rank").isNull() | F.col("to_rank").isNull(), "ok")
        .when(F.col("from_rank") < F.col("to_rank"), "ok")
        .otherwise("violation")
    )
    return rows.select(*EDGE, "total_edges", "from_layer", "to_layer", verdict.alias("verdict"))


def call_layer_violations(calls: DataFrame, layers: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Function-level layer check over calls(src, dst); layers(id, layer) has '' for unknown.

    api to dao skips a layer; a call against the order api, service, dao, util
    is reversed unless it ends in util.
    """
    order = {"api": 0, "service": 1, "dao": 2, "util": 3}
    rank = lambda c: F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col(c)]
    explicit = F.lit(False)
    for a, b in allowed:
        explicit = explicit | ((F.col("from_layer") == a) & (F.col("to_layer") == b))
    kind = (
        F.when((F.col("from_layer") == "") | (F.col("to_layer") == ""), None)
        .when((F.col("from_layer") == F.col("to_layer")) | explicit, None)
        .when((F.col("from_layer") == "api") & (F.col("to_layer") == "dao"), "skip_layer")
        .when((rank("from_layer") > rank("to_layer")) & (F.col("to_layer") != "util"), "reverse_dep")
    )
    return (
        calls.join(layers.toDF("src", "from_layer"), "src")
        .join(layers.toDF("dst", "to_layer"), "dst")
        .filter("from_layer <> ''")
        .select("src", "dst", "from_layer", "to_layer", kind.alias("violation"))
    )


def flow_steps(flows: DataFrame) -> DataFrame:
    """(flow, step, from, to, input, output, next_input) from flows(name, steps)."""
    return flows.select(
        F.col("name").alias("flow"),
        F.posexplode(
            F.transform(
                "steps",
                lambda s, i: F.struct(s.alias("s"), F.try_element_at(F.col("steps"), i + 2).alias("nxt")),
            )
        ).alias("step", "x"),
    ).select(
        "flow",
        "step",
        F.col("x.s.from").alias("caller"),
        F.col("x.s.to").alias("callee"),
        F.col("x.s.input").alias("input"),
        F.col("x.s.output").alias("output"),
        F.col("x.nxt.input").alias("next_input"),
    )


def flow_missing(flows: DataFrame, relations: DataFrame) -> DataFrame:
    """Flow steps without an actual edge."""
    return flow_steps(flows).select("flow", "step", *EDGE).join(relations.select(*EDGE), EDGE, "left_anti")


def flow_nodes(flows: DataFrame) -> DataFrame:
    """(name, nodes): chained node list; a node follows only where the next step breaks the chain."""
    chained = F.flatten(
        F.transform(
            "steps",
            lambda s, i: F.when(
                (i > 0) & (F.try_element_at(F.col("steps"), F.when(i > 0, i))["to"] == s["from"]), F.array(s["to"])
            ).otherwise(F.array(s["from"], s["to"])),
        )
    )
    return flows.select("name", chained.alias("nodes"))


def flow_shortcuts(flows: DataFrame, relations: DataFrame) -> DataFrame:
    """Actual edges that jump over at least one node of a flow.

    Edges meet the flow's node positions by two equi joins (caller, then flow and
    callee), so the node pairs of a flow are never enumerated.
    """
    chains = flow_nodes(flows)
    at = chains.select("name", F.posexplode("nodes").alias("pos", "node"))
    jumps = (
        relations.select(*EDGE)
        .join(at.toDF("name", "i", "caller"), "caller")
        .join(at.toDF("name", "j", "callee"), ["name", "callee"])
        .filter("j >= i + 2")
    )
    return jumps.join(chains, "name").select(
        F.col("name").alias("flow"),
        "caller",
        "callee",
        "i",
        "j",
        F.array_join(F.slice("nodes", F.col("i") + 2, F.col("j") - F.col("i") - 1), ",").alias("bypassed"),
    )


def flow_continuity(flows: DataFrame) -> DataFrame:
    """Input fields of a step that the step before does not output; empty maps are skipped."""
    steps = flow_steps(flows).filter((F.size("output") > 0) & (F.size("next_input") > 0))
    return steps.select(
        "flow",
        "step",
        F.explode(F.array_except(F.map_keys("next_input"), F.map_keys("output"))).alias("field"),
    )


def boundary_leaks(refs: DataFrame, path_module: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(module, total_refs, leaked_refs): outside references that miss every public glob."""
    pairs = module_pairs(refs, path_module).withColumn("n", F.col("imports") + F.col("calls"))
    into = pairs.groupBy(F.col("callee").alias("module_id"), F.col("dst_path").alias("path")).agg(F.sum("n").alias("n"))
    globs = boundaries.select("module_id", F.explode_outer("public_paths").alias("glob")).select(
        "module_id", P.glob_folder(F.col("glob")).alias("folder"), P.glob_regex(F.col("glob")).alias("regex")
    )
    scoped = into.join(boundaries.select("module_id").distinct(), "module_id", "left_semi")
    scoped = Scratch(refs.sparkSession, "boundary").save(scoped, "scoped")
    public = (
        scoped.select("module_id", "path", F.explode(P.folders(F.col("path"))).alias("folder"))
        .join(globs.filter("regex IS NOT NULL"), ["module_id", "folder"])
        .filter(F.regexp_like("path", F.col("regex")))
        .select("module_id", "path", F.lit(True).alias("public"))
        .distinct()
    )
    return (
        scoped.join(public, ["module_id", "path"], "left")
        .groupBy("module_id")
        .agg(F.sum("n").alias("total_refs"), F.coalesce(F.sum(F.when(F.col("public").isNull(), F.col("n"))), F.lit(0)).alias("leaked_refs"))
    )


def event_findings(events: DataFrame, modules: DataFrame, relations: DataFrame) -> DataFrame:
    """(event, finding, producer, consumer): orphan, ghost_consumer, missing_edge, reverse_edge."""
    none = F.lit(None).cast("string")
    orphans = events.filter(F.size("consumers") <= 0).select(F.col("name").alias("event"), F.lit("orphan").alias("finding"), none.alias("producer"), none.alias("consumer"))
    consumers = events.select(F.col("name").alias("event"), "producers", F.explode("consumers").alias("consumer"))
    ghosts = consumers.join(modules.select(F.col("module_id").alias("consumer")), "consumer", "left_anti").select(
        "event", F.lit("ghost_consumer").alias("finding"), none.alias("producer"), "consumer"
    )
    links = consumers.select("event", F.explode("producers").alias("producer"), "consumer")
    actual = relations.select(F.col("caller").alias("producer"), F.col("callee").alias("consumer"))
    missing = links.join(actual, ["producer", "consumer"], "left_anti").select(
        "event", F.lit("missing_edge").alias("finding"), "producer", "consumer"
    )
    back = relations.select(F.col("caller").alias("consumer"), F.col("callee").alias("producer"))
    reverse = links.join(back, ["producer", "consumer"], "left_semi").select(
        "event", F.lit("reverse_edge").alias("finding"), "producer", "consumer"
    )
    return orphans.unionByName(ghosts).unionByName(missing).unionByName(reverse)


def event_links(events: DataFrame, relations: DataFrame) -> DataFrame:
    """(event, consumer, producers, linked, missing, reversed) for each consumer of an event that has producers.

    Counts of the producer-consumer pairs of an event without listing them: ``producers`` pairs are wanted, ``linked`` have
    the edge producer to consumer, ``missing`` have not, ``reversed`` have the edge back. Only edges that exist meet the
    producers, and they are counted by event and consumer before they meet the consumers, so no pair of an event is
    shuffled for itself. The events are written once, as both sides read them. Repeated names in a list count once.
    """
    events = Scratch(events.sparkSession, "event_links").save(events.select("name", "producers", "consumers"), "events")
    side = lambda c, name: events.select(F.col("name").alias("event"), F.explode(F.array_distinct(c)).alias(name))
    makers, takers = side("producers", "producer"), side("consumers", "consumer")

    def way(maker: str, taker: str, linked: int) -> DataFrame:
        ends = relations.select(F.col(maker).alias("producer"), F.col(taker).alias("consumer"))
        return ends.select("producer", "consumer", F.lit(linked).alias("linked"), F.lit(1 - linked).alias("reversed"))

    edges = way("caller", "callee", 1).union(way("callee", "caller", 0)).groupBy("producer", "consumer").agg(F.max("linked").alias("linked"), F.max("reversed").alias("reversed"))
    met = makers.join(edges, "producer").groupBy("event", "consumer").agg(F.sum("linked").alias("linked"), F.sum("reversed").alias("reversed"))
    wanted = makers.groupBy("event").agg(F.count("*").alias("producers"))
    rows = takers.join(wanted, "event").join(met, ["event", "consumer"], "left").fillna(0, ["linked", "reversed"])
    return rows.select("event", "consumer", "producers", "linked", (F.col("producers") - F.col("linked")).alias("missing"), "reversed")


def contract_complexity(contracts: DataFrame, flows: DataFrame, events: DataFrame, expected: DataFrame) -> DataFrame:
    """(module_id, contract, complexity) from kind, flow and event membership and out edges."""
    in_flow = flow_steps(flows).select(F.explode(F.array(*EDGE)).alias("module_id")).distinct().withColumn("in_flow", F.lit(True))
    in_event = (
        events.select(F.explode(F.concat("producers", "consumers")).alias("module_id")).distinct().withColumn("in_event", F.lit(True))
    )
    out = expected.filter("allowed").groupBy(F.col("caller").alias("module_id")).agg(F.count("*").alias("out_edges"))
    rows = (
        contracts.join(in_flow, "module_id", "left").join(in_event, "module_id", "left").join(out, "module_id", "left")
    )
    flow, event = F.col("in_flow").isNotNull(), F.col("in_event").isNotNull()
    edges = F.coalesce("out_edges", F.lit(0))
    alone = ~flow & ~event & (edges <= 1)
    return rows.select(
        "module_id",
        F.col("name").alias("contract"),
        F.when(F.col("kind") == "crud", "crud")
        .when((F.col("kind") == "query") & alone, "crud")
        .when((F.col("kind") == "command") & alone, "simple_command")
        .when(flow, "flow_participant")
        .when(event, "event_participant")
        .when(edges >= 2, "complex_orchestration")
        .otherwise("simple_command")
        .alias("complexity"),
    )


def contract_sources(flows: DataFrame, boundaries: DataFrame, events: DataFrame) -> DataFrame:
    """(source, owner, item, fields): one row per flow step with fields, boundary contract, event x consumer."""
    steps = flow_steps(flows)
    field_list = lambda *maps: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*[F.map_keys(m) for m in maps])))), ",")
    from_steps = steps.filter((F.size("input") > 0) | (F.size("output") > 0)).select(
        F.lit("flow").alias("source"),
        F.col("flow").alias("owner"),
        F.concat_ws("->", *EDGE).alias("item"),
        field_list("input", "output").alias("fields"),
    )
    from_bounds = boundaries.select("module_id", F.explode("contracts").alias("c")).select(
        F.lit("boundary").alias("source"),
        F.col("module_id").alias("owner"),
        F.col("c.name").alias("item"),
        field_list("c.input", "c.output").alias("fields"),
    )
    from_events = events.filter(F.size("payload") > 0).select(
        F.lit("event").alias("source"),
        F.col("name").alias("owner"),
        F.explode("consumers").alias("item"),
        field_list("payload").alias("fields"),
    )
    return from_steps.unionByName(from_bounds).unionByName(from_events)


def verdict_code(mode: str, target_gate: Column, transition_gate: Column, forbidden: Column, layer: Column, findings: Column) -> Column:
    """Run verdict: 2 on forbidden edges, a failed gate of the enforced profile or a layer violation; else 1 on findings."""
    gate_failed = {
        "target": ~target_gate,
        "transition": ~transition_gate,
        "both": ~target_gate | ~transition_gate,
    }[mode]
    return F.when((forbidden > 0) | gate_failed | (layer > 0), 2).when(findings > 0, 1).otherwise(0)
