"""What the large tables cost on their way: aggregates that must hash, groups that must not be shuffled, same answers."""

import random
import re

from conftest import rows

from edgeloom.operators import relations as R
from edgeloom.sources import documents as S


def aggregates(df):
    """Aggregate lines of the physical plan, from the top down to the input."""
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in x]


def test_relations_count_before_the_target_and_group_no_pairs_of_paths(spark):
    kinds = ["import", "call", "other", None]
    refs = [(f"s{i % 5}", f"d{i % 3}", kinds[i % 4]) for i in range(120)] + [("s0", "nowhere", "call"), ("nowhere", "d0", "call"), (None, "d0", "call")]
    modules = {**{f"s{i}": "AB"[i % 2] for i in range(5)}, **{f"d{i}": "ABC"[i] for i in range(3)}}
    got = R.relation_weights(spark.createDataFrame(refs, "src_path string, dst_path string, kind string"), spark.createDataFrame(list(modules.items()), "path string, module string"))
    want = {}
    for s, d, k in refs:
        a, b = modules.get(s), modules.get(d)
        if a and b and a != b:
            n = want.setdefault((a, b), [0, 0])
            n[0], n[1] = n[0] + (k == "import"), n[1] + (k == "call")
    assert rows(got) == sorted(((a, b, i, c, i + c) for (a, b), (i, c) in want.items()), key=repr)
    assert not [x for x in aggregates(got) if "src_path" in x and "dst_path" in x]


def test_hints_are_hashed_before_texts_are_compared(spark):
    relations = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "e")], "caller string, callee string")
    hints = [
        ("a", "b", "framework", "v", 0.8, "d", "r"), ("a", "b", "framework", "v", 0.9, "d", "r"), ("a", "b", "direct", "vv", 1.0, "d", "r"),
        ("a", "c", "framework", "v", 0.3, "d", "r"), ("a", "c", "framework", "v", 0.5, "d", "r"), ("a", "c", "registration", "v", 0.2, None, "r"),
        ("a", "d", "registration", "v", float("nan"), "d", "r"), ("a", "d", "direct", None, None, "d", "r"),
    ]
    got = R.classify_edges(relations, spark.createDataFrame(hints, "caller string, callee string, call_type_hint string, via string, confidence double, detector string, reason string"))
    weak = "hint confidence 0.20 below threshold 0.75"
    assert rows(got) == [
        ("a", "b", "framework_injection", "v", 0.9, "ast_hint", "d", "r"), ("a", "c", "direct_call", "", 1.0, "fallback", "", weak),
        ("a", "d", "direct_call", None, 0.0, "ast_hint", "d", "r"), ("a", "e", "direct_call", "", 1.0, "fallback", "", "no relation hint"),
    ]
    assert "HashAggregate" in aggregates(got)[-1]


def added_by_hand(text):
    """(file, line_no) of the added lines of one diff, line by line."""
    file, start, moved, out = None, 0, 0, []
    lines = text.split("\n")
    for x in lines[:-1] if lines[-1] == "" else lines:
        if x.startswith("@@ "):
            number = re.search(r"\+(\d+)", x)
            start, moved = int(number.group(1)) if number else 0, 0
            continue
        if x.startswith("+") and not x.startswith("+++"):
            out.append((file, start + moved))
        named = re.match(r"diff --git a/\S+ b/(\S+)", x)
        file = named.group(1) if named else file
        moved += not (x.startswith("-") and not x.startswith("---"))
    return out


def test_changed_lines_stay_in_the_row_of_their_diff(spark):
    deal = random.Random(3)
    some = ["diff --git a/x b/f1", "diff --git a/x b/f2", "diff --git broken", "--- a/x", "+++ b/x", "@@ -1,2 +7,3 @@ fn", "@@ -1 +20 @@", "@@ none", " ctx", "-old", "+new", "+more", "+", "", "@@not"]
    docs = [(i, "\n".join(deal.choice(some) for _ in range(deal.randrange(1, 40)))) for i in range(300)] + [(300, None), (301, ""), (302, "+a\n"), (303, " x\n+a")]
    got = S.changed_lines(spark.createDataFrame(docs, "doc bigint, text string"))
    assert rows(got, "doc", "file", "line_no") == sorted(((d, f, n) for d, t in docs if t for f, n in added_by_hand(t)), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Window"))
