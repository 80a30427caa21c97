"""Counted forms against the listed ones, and rules that look at the next line against the plain way."""

from conftest import rows

from edgeloom.operators import contracts as C
from edgeloom.operators import coverage as V
from edgeloom.operators import drift as DR
from edgeloom.operators import findings as D
from edgeloom.operators import reach as G
from edgeloom.operators import relations as R
from edgeloom.sources import documents as S
from edgeloom.sources import records as J


def test_event_links_count_what_event_findings_lists(spark):
    schema = "name string, producers array<string>, consumers array<string>"
    events = spark.createDataFrame([("e", ["a", "b", "b"], ["b", "c", "ghost"]), ("f", [], ["a"]), ("g", ["a"], []), ("h", None, None)], schema)
    relations = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "c"), ("b", "ghost"), ("z", "b")], "caller string, callee string")
    assert rows(C.event_links(events, relations)) == [("e", "b", 2, 0, 2, 0), ("e", "c", 2, 1, 1, 1), ("e", "ghost", 2, 1, 1, 0)]
    modules = spark.createDataFrame([(x,) for x in "abc"], "module_id string")
    listed = C.event_findings(events, modules, relations).filter("finding = 'missing_edge'").distinct().groupBy("event", "consumer").count()
    assert rows(listed, "event", "consumer", "count") == [("e", "b", 2), ("e", "c", 1), ("e", "ghost", 1)]


def test_search_groups_count_what_search_lists(spark):
    nodes = spark.createDataFrame(
        [(1, "f", "m"), (2, "f", "m"), (3, "g", "m"), (4, "f", "n"), (5, None, "m"), (6, None, "m"), (7, "h", None), (8, "h", "m")],
        "id long, file string, module string",
    )
    edges = spark.createDataFrame([(1, 3), (4, 1), (5, 2), (1, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(x,) for x in range(1, 9)], "seed long")
    listed = G.search(edges, nodes, seeds, 1).filter("relation LIKE 'same%'").groupBy("seed", "relation").count()
    assert rows(G.search_groups(edges, nodes, seeds, 1), "seed", "relation", "found") == rows(listed)


def test_longest_known_head_names_the_module(spark):
    texts = spark.createDataFrame([(1, "use A.B.C.d and A.B, not X.Y"), (2, None), (3, "A.B.C.d")], "doc long, text string")
    names = spark.createDataFrame([("A.B", "short"), ("A.B.C", "long"), ("A.B.C", "other")], "name string, module string")
    assert rows(R.referenced_modules(texts, names, "doc")) == [(1, "A.B", "short"), (1, "A.B.C", "long"), (3, "A.B.C", "long")]


def test_handler_lines_see_what_follows_them(spark):
    text = ["try:", "except:", "", "# note", "pass", "x = 1", "except Exception:", "raise", None, "except ValueError:"]
    lines = [("a.py", "python", k + 1, x) for k, x in enumerate(text)] + [("b.py", "python", 1, "x = eval(y)"), ("c.ex", "elixir", 1, "rescue"), ("c.ex", "elixir", 2, "_ -> nil")]
    df = spark.createDataFrame(lines, "file string, lang string, line long, text string")
    found = rows(D.scan_lines(df, D.line_rules()))
    assert found == rows(D.scan(D.with_next(df), D.line_rules()))
    assert {(r[0], r[1], r[2]) for r in found} >= {("a.py", 2, "swallowed_error"), ("c.ex", 1, "broad_catch"), ("b.py", 1, "injection_risk")}


def test_imports_are_trimmed_and_distinct(spark):
    schema = "sourcePath string, imports array<struct<specifier: string, kind: string>>"
    data = [("a", [(" x   y ", "use"), ("x\ty", " use "), ("z", " "), (" ", "use"), (None, "use")]), ("b", None)]
    assert rows(J.distinct_imports(spark.createDataFrame(data, schema))) == [("a", "use", "x y")]


SCENARIOS = """GIVEN stray
[SCENARIO: A] TITLE: one TAGS: integration strict_unique
GIVEN create_product product_id="P1"
WHEN try_pay sleep
THEN assert_noop
[SCENARIO: B-SEED-K] TITLE: two TAGS: e2e strict_evidence
THEN then_seed_contract_should_hold
[SCENARIO: C]"""


def test_one_pass_lint_equals_the_joined_one(spark):
    docs = spark.createDataFrame([(1, SCENARIOS), (2, "no scenario"), (3, None), (4, ""), (5, "[SCENARIO: D] TAGS: integration\nWHEN pay")], "doc long, text string")
    schema = "name string, kind string, assert_class string, is_async boolean, is_eventually boolean, boundary string"
    instructions = spark.createDataFrame([("assert_noop", "then", "weak", False, False, None), ("pay", "when", None, True, None, None)], schema)
    contracts = spark.createDataFrame([("K", "reactor_contract", 0, 0, 0)], "contract_id string, edge_class string, action_steps int, branch_hints int, facts int")
    scenarios, steps, lines = S.scenarios(docs), S.steps(docs), S.scenario_rows(docs)
    assert rows(lines.filter("is_header").select("doc", "segment", "line", "scenario.id")) == rows(scenarios, "doc", "segment", "line", "id")
    assert rows(lines.filter("NOT is_header").select("doc", "segment", "line", "kind", "name", "raw")) == rows(steps, "doc", "segment", "line", "kind", "name", "raw")
    found = rows(V.scenario_lint(scenarios, steps, instructions, contracts))
    assert found and found == rows(V.lint_rows(lines, instructions, contracts).drop("tags"))
    assert rows(V.step_lint(steps, scenarios)) == rows(V.step_lint_rows(lines)) != []
    suites = spark.createDataFrame([(1, "s1"), (5, "s5")], "doc long, suite string")
    assert rows(V.negative_rows(lines, suites, "suite")) == rows(V.negative_coverage(scenarios.join(suites, "doc"), steps, "suite")) == [("s5", 1, 0)]


def test_all_gates_from_one_pass(spark):
    warnings = spark.createDataFrame([("a.dsl", ["e2e"]), ("b/c.dsl", None)], "file string, tags array<string>")
    gates = {"tag": (["e2e"], None), "other": (["x"], None), "file": (None, ["b/**"]), "any": (None, None)}
    assert rows(V.warning_gates(warnings, gates)) == [(2, True, False, True, True)]
    assert rows(V.warning_gates(warnings.limit(0), gates)) == [(0, False, False, False, False)]
    assert rows(V.warning_gate(warnings, enabled=False)) == [(2, False)]


def test_event_links_count_before_they_meet_the_consumers(spark):
    """Against a plain count over all pairs; candidates of an event are counted, never matched one by one."""
    names = [f"m{i}" for i in range(7)]
    lists = [(f"e{i}", names[i % 4 : i % 4 + 3] + names[:1], names[i % 3 :: 2]) for i in range(9)] + [("bare", [], names), ("none", None, names)]
    edges = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if (i * 5 + j * 3) % 4]
    events = spark.createDataFrame(lists, "name string, producers array<string>, consumers array<string>")
    found = C.event_links(events, spark.createDataFrame(edges + edges[:5], "caller string, callee string"))
    want = []
    for event, makers, takers in lists:
        for taker in set(takers) if makers else ():
            linked = sum((m, taker) in edges for m in set(makers))
            want.append((event, taker, len(set(makers)), linked, len(set(makers)) - linked, sum((taker, m) in edges for m in set(makers))))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_conflict_tiers_cut_sides_into_lines_once(spark):
    """F8: all tests share the lines of a side; documents that their hunks decide are not cut."""
    side = lambda *pairs: "".join(f"<<<<<<< a\n{o}\n=======\n{t}\n>>>>>>> b\n" for o, t in pairs)
    texts = [
        ("a/b.ts", side(("x = 1", "x = 2")), "assist"), ("a/b.ts", side(("x = 1", " x=1 ")), "auto"), ("a/b.ts", side(("// a", "/* b\n c */")), "auto"),
        ("a/b.yml", side(("# a", "")), "auto"), ("a/b.ts", side(("# a", "")), "assist"), ("a/b.ts", side(*[("x = 1", "x = 2")] * 7), "human"),
        ("a/b.ts", side(*[("x = 1", "x = 2")] * 3), "human"), ("a/b.go", side(*[('import "a"', '"b" // c')] * 3), "assist"), ("a/b.rs", side(*[("use a::b;", "// n\nuse c;")] * 4), "assist"),
        ("a/b.ex", side(*[("alias A", "import B")] * 3), "assist"), ("a/b.rs", side(("a", "impl X")), "human"), ("a/b.go", side(("a", "Type X Interface {")), "human"),
        ("a/b.ts", side(("y\n" * 61, "x\n" * 60)), "human"), ("docs/a.ts", side(*[("x", "y")] * 3), "auto"), ("docs/a.ts", side(*[("x", "y")] * 4), "human"), ("q.sql", side(("x", "y")), "human"), ("a/b.ts", "plain", "human"),
    ]
    files = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(texts)], "doc long, path string, text string")
    found = DR.conflict_tiers(DR.conflict_hunks(files))
    assert [r.tier for r in sorted(found.collect(), key=lambda r: r.doc)] == [x for _, _, x in texts]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4


def test_scenarios_are_cut_inside_their_document(spark):
    """F9, F11, F16: no window and no sort of lines; equal to the windowed scenarios and steps."""
    odd = "\n# c\n THEN early\n[SCENARIO: A]\n\n  [SCENARIO: ] x \n[SCENARIO: B] TAGS: e2e  integration\nTHEN assert_last_error\n#\nWHEN try_x\nTHEN assert_last_errors\n"
    docs = spark.createDataFrame([(1, SCENARIOS), (2, odd), (3, None), (4, "x [SCENARIO: no"), (5, "[SCENARIO: D] TAGS: integration\nTHEN assert_last_errors\nGIVEN try_")], "doc long, text string")
    blocks, lines = S.scenario_blocks(docs), S.scenario_rows(docs)
    assert rows(blocks, "doc", "segment", "line", "id", "title", "tags") == rows(S.scenarios(docs), "doc", "segment", "line", "id", "title", "tags")
    assert rows(lines.filter("NOT is_header"), "doc", "segment", "line", "kind", "name", "raw") == rows(S.steps(docs), "doc", "segment", "line", "kind", "name", "raw")
    suites = spark.createDataFrame([(k, f"s{k}") for k in range(1, 6)], "doc long, suite string")
    assert rows(V.negative_blocks(blocks, suites, "suite")) == rows(V.negative_rows(lines, suites, "suite")) == rows(V.negative_coverage(S.scenarios(docs).join(suites, "doc"), S.steps(docs), "suite")) == [("s5", 1, 0)]
    instructions = spark.createDataFrame([("pay", "when", None, True, None, None)], "name string, kind string, assert_class string, is_async boolean, is_eventually boolean, boundary string")
    contracts = spark.createDataFrame([("K", "reactor_contract", 0, 0, 0)], "contract_id string, edge_class string, action_steps int, branch_hints int, facts int")
    plan = V.lint_rows(lines, instructions, contracts)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan
