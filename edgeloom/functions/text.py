"""Column functions over text: references, fields, slugs, markers, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker types that may appear in comments.
MARKER_TYPES = (
    "BOT:PLAN_DRAFT", "BOT:DISCUSSION_SUMMARY", "BOT:PLAN_FINAL", "BOT:PR_CREATED", "BOT:CONVERGE_WARNING",
    "BOT:DISCUSSION_ROUND_LIMIT_NOTICE", "BOT:LABEL_GUARD", "BOT:GATE_RETRY", "BOT:IMPLEMENT_PROGRESS", "BOT:ITERATE_PROGRESS",
)
# Commit tags by keyword, in rule order.
TAG_RULES = (
    ("security", ("xss", "漏洞", "注入", "安全", "越权", "任意访问")),
    ("pagination", ("分页", "翻页", "page", "offset")),
    ("export", ("导出", "导入", "下载", "export")),
    ("datetime", ("时间", "日期", "时区", "utc", "timezone")),
    ("null_safety", ("空", "null", "为空", "类型", "type")),
    ("transaction", ("事务", "commit", "回滚", "rollback")),
    ("concurrency", ("并发", "锁", "重复", "concurrent")),
)
# Side effects by substring.
SIDE_EFFECTS = (
    ("has_async", ("async ", "await ")),
    ("has_http", ("fetch(", "axios", "ky(")),
    ("has_file_io", ("fs.", "readFile", "writeFile")),
    ("has_pubsub", ("EventEmitter", ".emit(")),
)
# Issue reference patterns.
REF_PATTERNS = (
    r"(?i)\b(?:issue|closes?|closed|fixes?|fixed|resolves?|resolved|refs?)\s*#([0-9]+)\b",
    r"(?i)\bsub\(\s*#([0-9]+)\s*\)",
    r"(?i)\bparent\(\s*#([0-9]+)\s*\)",
    r"\(\s*#([0-9]+)\s*\)",
)
PULL_REQUEST = r"(?i)pull request #([0-9]+)"
CLOSES = r"(?i)(?:closes|fixes|resolves)\s*#(\d+)"
DEPENDS_LINE = r"(?i)depends[- ]on:\s*(#\d[\d#\s,]*)"
DEPENDS_END = r"#(?!\d)|(?<=[\s,])\d"
DEPENDS_MULTI = r"(?im)^(?:depends[- ]on|blocked[- ]by):\s*(.+)$"
PARENT = r"(?i)parent(?:\s+issue)?:\s*#(\d+)"
MARKER = r"<!--\s+(BOT:\w+(?:\s.*?)?)\s+-->"


def lines(text: Column) -> Column:
    """Lines without a final empty one; carriage returns before the break are dropped."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), r"\r?\n")


# Repetition in patterns stays on character classes: Java regexes recurse on
# repeated groups and overflow the stack on long texts.


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def numbers(found: Column) -> Column:
    return F.transform(found, lambda x: x.try_cast("bigint"))


def issue_refs(*texts: Column) -> Column:
    """Positive issue numbers over several texts, distinct and ascending."""
    found = []
    for text in texts:
        cleaned = F.regexp_replace(text, PULL_REQUEST, "")
        found += [all_matches(cleaned, p) for p in REF_PATTERNS]
    nums = F.filter(numbers(F.concat(*found)), lambda n: n > 0)
    return F.array_sort(F.array_distinct(nums))


def commit_refs(message: Column) -> Column:
    """``#n`` numbers of a commit message, repeats in a row removed."""
    nums = numbers(all_matches(message, r"#(\d+)"))
    return F.filter(nums, lambda x, i: (i == 0) | (F.try_element_at(nums, F.when(i > 0, i).cast("int")) != x))


def closing_refs(body: Column) -> Column:
    return numbers(all_matches(body, CLOSES))


def depends_on(body: Column, grammar: str = "line") -> Column:
    """Declared dependencies. ``line``: first depends-on list; ``multi``: every depends-on
    or blocked-by line, also ``owner/repo#n``, distinct in order."""
    if grammar == "line":
        listed = F.split(F.regexp_extract(body, DEPENDS_LINE, 1), DEPENDS_END)[0]
        return numbers(all_matches(listed, r"#(\d+)"))
    if grammar == "multi":
        rows = all_matches(body, DEPENDS_MULTI)
        refs = F.flatten(F.transform(rows, lambda r: all_matches(r, r"(?:[\w\-]+/[\w\-]+)?#(\d+)")))
        return numbers(F.array_distinct(refs))
    raise ValueError("grammar is line or multi")


def parent_issue(body: Column) -> Column:
    """Declared parent, 0 if none."""
    return F.coalesce(F.nullif(F.regexp_extract(body, PARENT, 1), F.lit("")).try_cast("bigint"), F.lit(0))


def gate_field(log: Column, key: str) -> Column:
    """First ``key=value`` token of a log, '' if none; a leading ``[gate]`` mark is not part of a token."""
    return F.regexp_extract(log, rf"(?:^|\s){key}=(\S+)", 1)


def slug(title: Column) -> Column:
    """Lower-case [a-z0-9] words joined by ``-``, at most 30 characters."""
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9 _-]", "")
    dashed = F.regexp_replace(kept, r"[ _-]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-|-$", ""), 1, 30)


def tags(message: Column) -> Column:
    lower = F.lower(message)
    found = []
    for tag, words in TAG_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | lower.contains(w)
        found.append(F.when(hit, F.lit(tag)))
    return F.array_compact(F.array(*found))


def size_grade(changed_lines: Column) -> Column:
    return F.when(changed_lines <= 10, "A").when(changed_lines <= 50, "B").otherwise("C")


def side_effects(text: Column) -> list[Column]:
    out = []
    for name, parts in SIDE_EFFECTS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        out.append(hit.alias(name))
    return out


def compare_form(text: Column) -> Column:
    """Lower-case [a-z0-9 ] with single blanks, for similarity."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def may_resemble(a: Column, b: Column, threshold: float) -> Column:
    """False where the lengths alone rule out a similarity above the threshold."""
    return F.abs(F.length(a) - F.length(b)) < F.greatest(F.length(a), F.length(b)) * (1 - threshold)


def section_state(text: Column, heading: str) -> Column:
    """missing / empty / ok for the first ``## heading`` and its body up to the next ``## ``."""
    mark = F.lit(f"## {heading}")
    at = F.locate(f"## {heading}", text)
    after = F.substr(text, at + F.length(mark))
    end = F.locate("\n## ", after)
    body = F.when(end > 0, F.substr(after, F.lit(1), end - 1)).otherwise(after)
    return F.when(at == 0, "missing").when(F.regexp_replace(body, r"\s+", "") == "", "empty").otherwise("ok")


def scenario_quality(text: Column) -> Column:
    """Reasons why a scenario text is incomplete."""
    step = lambda word: ~text.rlike(rf"(?m)^{word} ")
    return F.array_compact(
        F.array(
            F.when(~text.contains("[SCENARIO:"), "missing [SCENARIO:] header"),
            F.when(step("GIVEN"), "missing GIVEN step"),
            F.when(step("WHEN"), "missing WHEN step"),
            F.when(step("THEN"), "missing THEN step"),
        )
    )
