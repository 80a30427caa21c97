"""Published worked examples: relation tables with known structure, scenario, gate and score results."""

import pytest
from conftest import rows

from edgeloom.operators import contracts as C
from edgeloom.operators import score as S

REL = "caller string, callee string, import_edges bigint, call_edges bigint, total_edges bigint"
EDGE = "caller string, callee string"
# The published relation, allow and forbid tables of the large worked example.
LARGE = """
agent_runtime channel_ingress 68 5
agent_runtime external_dependencies 2 0
agent_runtime foundation_infra 482 80
agent_runtime gateway_control_plane 36 8
agent_runtime ops_client_entry 23 4
agent_runtime plugin_tool_extension 40 3
channel_ingress agent_runtime 172 19
channel_ingress foundation_infra 343 55
channel_ingress gateway_control_plane 71 1
channel_ingress ops_client_entry 41 0
channel_ingress plugin_tool_extension 23 1
external_dependencies agent_runtime 1 1
external_dependencies foundation_infra 5 2
external_dependencies ops_client_entry 4 1
foundation_infra agent_runtime 74 11
foundation_infra channel_ingress 87 4
foundation_infra gateway_control_plane 33 7
foundation_infra ops_client_entry 33 11
foundation_infra platform_hosts 1 1
foundation_infra plugin_tool_extension 6 1
gateway_control_plane agent_runtime 66 9
gateway_control_plane channel_ingress 31 2
gateway_control_plane foundation_infra 266 28
gateway_control_plane ops_client_entry 36 1
gateway_control_plane platform_hosts 6 0
gateway_control_plane plugin_tool_extension 19 2
ops_client_entry agent_runtime 225 29
ops_client_entry channel_ingress 86 10
ops_client_entry external_dependencies 2 0
ops_client_entry foundation_infra 721 100
ops_client_entry gateway_control_plane 96 9
ops_client_entry platform_hosts 66 7
ops_client_entry plugin_tool_extension 31 5
platform_hosts agent_runtime 4 0
platform_hosts foundation_infra 23 6
platform_hosts gateway_control_plane 8 0
platform_hosts ops_client_entry 7 1
plugin_tool_extension agent_runtime 98 10
plugin_tool_extension channel_ingress 121 0
plugin_tool_extension foundation_infra 159 11
plugin_tool_extension gateway_control_plane 36 4
plugin_tool_extension ops_client_entry 30 2
"""  # caller, callee, import edges, call edges
ALLOW = """
gateway_control_plane agent_runtime
gateway_control_plane channel_ingress
gateway_control_plane foundation_infra
gateway_control_plane platform_hosts
agent_runtime plugin_tool_extension
agent_runtime foundation_infra
channel_ingress foundation_infra
channel_ingress agent_runtime
plugin_tool_extension foundation_infra
ops_client_entry gateway_control_plane
ops_client_entry foundation_infra
ops_client_entry agent_runtime
platform_hosts gateway_control_plane
platform_hosts foundation_infra
ops_client_entry channel_ingress
ops_client_entry platform_hosts
ops_client_entry plugin_tool_extension
channel_ingress gateway_control_plane
channel_ingress plugin_tool_extension
gateway_control_plane plugin_tool_extension
plugin_tool_extension agent_runtime
plugin_tool_extension gateway_control_plane
foundation_infra agent_runtime
agent_runtime gateway_control_plane
agent_runtime channel_ingress
ops_client_entry external_dependencies
agent_runtime external_dependencies
"""
FORBID = """
external_dependencies gateway_control_plane
external_dependencies agent_runtime
external_dependencies ops_client_entry
platform_hosts ops_client_entry
platform_hosts agent_runtime
foundation_infra plugin_tool_extension
"""
# Published gate limits, and the small worked example.
LIMITS = [
    ("transition", "unexpected_edges_count", 0), ("transition", "forbidden_edges_count", 5), ("transition", "forbidden_total_edges", 26),
    ("transition", "missing_edges_count", 0), ("transition", "directed_density_pct", 75), ("transition", "bidirectional_pair_count", 20),
    ("target", "unexpected_edges_count", 0), ("target", "forbidden_edges_count", 0), ("target", "forbidden_total_edges", 0),
    ("target", "missing_edges_count", 0), ("target", "directed_density_pct", 40), ("target", "bidirectional_pair_count", 5),
]
SMALL = [("AGENT", "DATA", 1), ("AGENT", "EXTENSIONS", 1), ("AGENT", "PROMPT", 1), ("AGENT", "TOOLS", 7), ("INFRA", "PROMPT", 1), ("INFRA", "PROVIDERS", 2), ("TOOLS", "DATA", 7)]
SMALL_ALLOW = [("AGENT", "DATA"), ("AGENT", "PROMPT"), ("COMPACTION", "PROVIDERS"), ("EXTENSIONS", "AGENT"), ("INFRA", "COMPACTION"), ("INFRA", "EXTENSIONS"), ("TOOLS", "DATA")]


def table(text):
    return [tuple(line.split()) for line in text.strip().splitlines()]


@pytest.fixture(scope="module")
def large(spark):
    rel = spark.createDataFrame([(a, b, int(m), int(n), int(m) + int(n)) for a, b, m, n in table(LARGE)], REL)
    allow, forbid = spark.createDataFrame(table(ALLOW), EDGE), spark.createDataFrame(table(FORBID), EDGE)
    extra = C.edge_classes(rel, allow, forbid).filter("class = 'unexpected'")
    return rel, allow, forbid, C.edge_set(allow, extra)


def test_large_structure(large):
    s = C.structure(large[0]).first()
    assert (s.modules_count, s.directed_edges_possible, s.directed_edges_actual, s.directed_density_pct, s.bidirectional_pair_count) == (8, 56, 42, 75.0, 20)
    assert tuple(C.top_pairs(large[0]).first()) == ("foundation_infra", "ops_client_entry", 44, 821, 865)


def test_large_scenarios_and_gates(spark, large):
    rel, allow, forbid, wide = large
    target, transition = C.evaluate("target", rel, allow, forbid), C.evaluate("transition", rel, wide, forbid)
    assert tuple(target.first()) == ("target", 27, 6, 27, 3665, 10, 442, 5, 26, 0)
    assert tuple(transition.first()) == ("transition", 37, 6, 37, 4107, 0, 0, 5, 26, 0)
    gates = C.gate_rows(target.unionByName(transition), C.structure(rel), spark.createDataFrame(LIMITS, "profile string, metric string, limit bigint"))
    assert rows(C.gate_verdicts(gates)) == [("target", False, 5), ("transition", True, 0)]


def test_small_example_and_score(spark):
    rel = spark.createDataFrame([(a, b, n, 0, n) for a, b, n in SMALL], REL)
    allow, forbid = spark.createDataFrame(SMALL_ALLOW, EDGE), spark.createDataFrame([], EDGE)
    scenario, st = C.evaluate("t", rel, allow, forbid), C.structure(rel)
    assert tuple(scenario.first())[1:] == (7, 0, 3, 9, 4, 11, 0, 0, 4)
    assert st.first().directed_density_pct == 16.67
    layers = spark.createDataFrame([], "verdict string")
    zero = spark.createDataFrame([(0.0, 0.0)], "bdd double, contract double")
    dims = S.dimensions(S.compliance(scenario), S.density(st), S.layering(layers), S.acyclic(st), S.coverage(zero))
    got = {r.mode: (round(r.total, 6), r.grade, r.passed) for r in S.total(dims).collect()}
    assert got == {"strict": (0.0, "F", False), "lenient": (50.0, "F", False), "warning": (70.0, "C", True)}
