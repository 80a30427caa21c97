"""Plan, dependency and manifest drift; whitelisted gates; fingerprints; conflict tiers; file overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.functions import text as X

# Conflict limits.
WHITELIST_HUNKS, AI_HUNKS, MILD_LINES, AI_LINES, MILD_HUNKS = 3, 6, 12, 120, 2
HUNK = r"(?ms)^<<<<<<<[^\n]*\n(.*?)^=======[^\n]*\n(.*?)^>>>>>>>"


def plan_drift(planned: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, path, drift): extra or missing files of plans that are not empty.

    Planned paths with ``..`` never whitelist; both sides are cleaned first.
    """
    wanted = planned.filter(~F.contains("path", F.lit(".."))).select(key, P.clean(F.col("path")).alias("path"), F.lit(True).alias("p")).distinct()
    done = actual.select(key, P.clean(F.col("path")).alias("path"), F.lit(True).alias("a")).distinct()
    done = done.join(planned.select(key).distinct(), key, "left_semi")
    return wanted.join(done, [key, "path"], "full").filter("p IS NULL OR a IS NULL").select(
        key, "path", F.when(F.col("p").isNull(), "extra").otherwise("missing").alias("drift")
    )


def dependency_diff(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(issue, dep, change) with change add or remove; self and non-positive pairs are ignored."""
    good = lambda df: df.filter("issue > 0 AND dep > 0 AND issue <> dep").select("issue", "dep").distinct()
    e, c = good(expected).withColumn("e", F.lit(True)), good(current).withColumn("c", F.lit(True))
    return e.join(c, ["issue", "dep"], "full").filter("e IS NULL OR c IS NULL").select(
        "issue", "dep", F.when(F.col("c").isNull(), "add").otherwise("remove").alias("change")
    )


def diff_totals(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count_if(F.col("change") == "add").alias("adds"), F.count_if(F.col("change") == "remove").alias("removes"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(edges, fingerprint) of the distinct rows, whatever their order.

    Per-row SHA-256 pieces are summed, which combines map-side; the sums are
    hashed once. No task sees the whole edge list.
    """
    h = F.sha2(F.concat_ws("->", *[F.col(c).cast("string") for c in columns]), 256)
    piece = lambda i: F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")
    sums = rows.select(*columns).distinct().select(h.alias("h")).agg(
        F.count("*").alias("edges"), *[F.coalesce(F.sum(piece(i)), F.lit(0).cast("decimal(30,0)")).alias(f"s{i}") for i in range(5)]
    )
    return sums.select("edges", F.sha2(F.concat_ws(",", F.col("edges").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)]), 256).alias("fingerprint"))


def task_edges(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(from_issue, to_issue, skipped): task dependencies as issue edges; skipped when an end has no issue."""
    issue = tasks.filter("issue > 0").select("task_id", "issue")
    return (
        deps.join(issue.toDF("task_id", "to_issue"), "task_id", "left").join(issue.toDF("dep", "from_issue"), "dep", "left")
        .select("from_issue", "to_issue", (F.col("from_issue").isNull() | F.col("to_issue").isNull()).alias("skipped"))
    )


def skipped_ratio(edges: DataFrame, threshold: float) -> DataFrame:
    ratio = F.when(F.count("*") > 0, F.count_if("skipped") / F.count("*")).otherwise(0.0)
    return edges.agg(F.count("*").alias("total_edges"), F.count_if("skipped").alias("skipped_edges"), F.round(ratio, 6).alias("ratio"), (ratio > threshold).alias("exceeded"))


# -- contract manifests ----------------------------------------------------------


def _required(t: Column) -> Column:
    return ~F.trim(t).endswith("?")


def _base(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(t), r"[!?]$", ""))


def _enum(t: Column) -> Column:
    inner = F.regexp_extract(_base(t), r"^enum\[(.*)\]$", 1)
    values = F.filter(F.transform(F.split(inner, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(_base(t).rlike(r"^enum\[.*\]$"), values)


def manifest_pairs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(contract_key, item[level, key, role, field, old, new]): everything that may differ.

    The two manifests meet in one full join on the contract; actions and fields
    are compared inside the joined row, so nothing is shuffled twice.
    """
    side = lambda m, name: m.select("contract_key", F.struct("kind", "fields", "actions").alias(name))
    both = side(baseline, "b").join(side(current, "c"), "contract_key", "full")
    none = F.lit(None).cast("string")

    def item(level: str, key: Column, role: Column, field: Column, old: Column, new: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), key.alias("key"), role.alias("role"), field.alias("field"), old.alias("old"), new.alias("new")
        )

    def fields(key: Column, role: str, old: Column, new: Column) -> Column:
        names = F.array_union(F.map_keys(old), F.map_keys(new))
        return F.transform(names, lambda f: item("field", key, F.lit(role), f, F.try_element_at(old, f), F.try_element_at(new, f)))

    by_key = lambda acts: F.map_from_entries(F.transform(acts, lambda x: F.struct(x["action_key"], x)))
    kind = lambda x: F.coalesce(x, F.lit(""))
    present = lambda x: F.when(x.isNotNull(), kind(x["kind"]))

    def action(k: Column) -> Column:
        old, new = F.try_element_at(F.col("ba"), k), F.try_element_at(F.col("ca"), k)
        head = F.array(item("action", k, none, none, present(old), present(new)))
        inner = F.concat(fields(k, "input", old["input"], new["input"]), fields(k, "output", old["output"], new["output"]))
        return F.when(old.isNotNull() & new.isNotNull(), F.concat(head, inner)).otherwise(head)

    shared = F.col("b").isNotNull() & F.col("c").isNotNull()
    rows = both.withColumns({"ba": F.when(shared, by_key(F.col("b.actions"))), "ca": F.when(shared, by_key(F.col("c.actions")))})
    contract = F.array(item("contract", F.lit(""), none, none, present(F.col("b")), present(F.col("c"))))
    inside = F.concat(
        contract,
        fields(F.lit(""), "field", F.col("b.fields"), F.col("c.fields")),
        F.flatten(F.transform(F.array_union(F.map_keys("ba"), F.map_keys("ca")), action)),
    )
    return rows.select("contract_key", F.explode(F.when(shared, inside).otherwise(contract)).alias("item"))


def manifest_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(id, category): BREAKING, DANGEROUS and SAFE changes between two manifests.

    manifest(contract_key, kind, fields MAP, actions[action_key, kind, input MAP, output MAP]).
    """
    x = manifest_pairs(baseline, current).select("contract_key", "item.*")
    c, key, old, new = F.col("contract_key"), F.col("key"), F.col("old"), F.col("new")
    gone, fresh = new.isNull(), old.isNull()
    kept = ~gone & ~fresh & (old != new)
    as_input = F.col("role") == "input"
    tightened = kept & ~_required(old) & _required(new)
    place = F.when(key == "", F.concat_ws(".", c, F.lit("fields"), "field")).otherwise(F.concat_ws(".", c, key, "role", "field"))
    named = F.when(F.col("level") == "field", place).when(F.col("level") == "action", F.concat_ws(":", c, key)).otherwise(c)
    field, on = F.col("level") == "field", lambda level: F.col("level") == level
    rekind = kept & (old != "") & (new != "")
    found = lambda test, category, kind: F.when(
        test, F.struct(F.concat_ws(":", F.lit(category), F.lit(kind), named).alias("id"), F.lit(category).alias("category"))
    )
    checks = [
        found(on("contract") & gone, "BREAKING", "contract_removed"),
        found(on("contract") & fresh, "SAFE", "contract_added"),
        found(on("contract") & rekind, "BREAKING", "contract_graphql_kind_changed"),
        found(on("action") & gone, "BREAKING", "action_removed"),
        found(on("action") & fresh, "SAFE", "action_added"),
        found(on("action") & rekind, "BREAKING", "action_graphql_kind_changed"),
        found(field & gone, "BREAKING", "field_removed"),
        found(field & kept & (_base(old) != _base(new)), "BREAKING", "type_changed"),
        found(field & tightened & as_input, "DANGEROUS", "input_required"),
        found(field & tightened & ~as_input, "BREAKING", "field_non_null"),
        found(field & fresh & as_input & _required(new), "DANGEROUS", "required_argument_added"),
        found(field & fresh & ~(as_input & _required(new)), "SAFE", "field_added"),
    ]
    lost = F.when(field & kept, F.array_distinct(F.array_except(_enum(old), _enum(new))))
    values = F.transform(
        F.coalesce(lost, F.array().cast("array<string>")),
        lambda v: F.struct(F.concat_ws(":", F.lit("DANGEROUS:enum_value_removed"), named, v).alias("id"), F.lit("DANGEROUS").alias("category")),
    )
    return x.select(F.explode(F.concat(F.array_compact(F.array(*checks)), values)).alias("f")).select("f.*")


def whitelist_gate(findings: DataFrame, whitelist: DataFrame, now: Column, warn_days: int = 7) -> DataFrame:
    """Findings that are not SAFE with status unwhitelisted / expired_whitelist / expiring / whitelisted.

    findings(id, category), whitelist(id, expires_at); ``now`` and expires_at are comparable epoch seconds.
    """
    e = F.col("expires_at")
    status = (
        F.when(e.isNull(), "unwhitelisted").when(e < now, "expired_whitelist").when(e <= now + warn_days * 86400, "expiring").otherwise("whitelisted")
    )
    rows = findings.withColumn("category", F.upper("category")).filter("category <> 'SAFE'").join(whitelist.select("id", "expires_at"), "id", "left")
    return rows.select("id", "category", status.alias("status"))


def gate_result(rows: DataFrame, fail_on_dangerous: bool = False) -> DataFrame:
    """(violations, warnings, strict_passed, warn_passed)."""
    violation = F.col("status").isin("unwhitelisted", "expired_whitelist") & (F.col("category").isin("BREAKING", "DANGEROUS") | (F.col("status") == "expired_whitelist"))
    fatal = (F.col("status") == "expired_whitelist") | (
        (F.col("status") == "unwhitelisted") & (F.col("category").isin("BREAKING", "DANGEROUS") if fail_on_dangerous else (F.col("category") == "BREAKING"))
    )
    return rows.agg(
        F.count_if(violation).alias("violations"), F.count_if(F.col("status") == "expiring").alias("warnings"),
        (F.count_if(fatal) == 0).alias("strict_passed"), F.lit(True).alias("warn_passed"),
    )


# -- merge conflicts ---------------------------------------------------------------


def conflict_hunks(files: DataFrame) -> DataFrame:
    """files(doc, path, text) plus hunks[ours, theirs] and ``malformed`` for an unclosed mark."""
    ours, theirs = X.all_matches(F.col("text"), HUNK, 1), X.all_matches(F.col("text"), HUNK, 2)
    rest = F.regexp_replace("text", HUNK, "")
    return files.select(
        "doc", "path", F.arrays_zip(ours.alias("ours"), theirs.alias("theirs")).alias("hunks"), rest.rlike(r"(?m)^<<<<<<<").alias("malformed")
    )


def conflict_counts(hunked: DataFrame) -> DataFrame:
    """(doc, path, hunks); malformed files are errors and are listed by :func:`conflict_errors`."""
    return hunked.filter("NOT malformed").select("doc", "path", F.size("hunks").alias("hunks"))


def conflict_errors(hunked: DataFrame) -> DataFrame:
    return hunked.filter("malformed").select("doc", "path", F.lit("unclosed_conflict").alias("error"))


def conflict_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("files"), F.sum("hunks").cast("bigint").alias("hunks"))


# Suffixes of files with "#" comments.
HASH_COMMENT_SUFFIXES = (".md", ".markdown", ".yml", ".yaml", ".toml", ".sh", ".py", ".ini", ".conf", ".txt", ".gitignore")


def _filled(side: Column) -> Column:
    return F.filter(F.transform(F.split(side, "\n"), lambda x: F.trim(x)), lambda x: x != "")


COMMENT_MARKS = ("//", "*/", "<!--", "-->")


def _comment_free(side: Column, hash_comments: Column) -> Column:
    """Text of a side without comment lines, leading block comments and blanks; a side without any mark is not cut into lines."""
    no_blocks = F.when(F.contains(side, F.lit("/*")), F.regexp_replace(side, r"(?ms)^\s*/\*.*?(\*/|\z)", "")).otherwise(side)
    comment = lambda x: P.any_of(x.startswith(m) for m in COMMENT_MARKS) | (hash_comments & x.startswith("#"))
    marked = P.any_of(F.contains(side, F.lit(m)) for m in (*COMMENT_MARKS, "/*", "#"))
    kept = F.when(marked, F.array_join(F.filter(_filled(no_blocks), lambda x: ~comment(x)), "")).otherwise(side)
    return F.regexp_replace(kept, r"\s+", "")


def _all_lines(rows: Column, counted: str, ignored: str) -> Column:
    """Every filled line is ignored or counted, and at least one is counted."""
    return F.forall(rows, lambda x: x.rlike(counted) | x.rlike(ignored)) & F.exists(rows, lambda x: x.rlike(counted))


def _with_lines(hunks: Column) -> Column:
    """Hunks with the filled lines of both sides beside their texts."""
    return F.transform(hunks, lambda h: F.struct(h["ours"].alias("ours"), h["theirs"].alias("theirs"), _filled(h["ours"]).alias("o"), _filled(h["theirs"]).alias("t")))


def conflict_tiers(hunked: DataFrame) -> DataFrame:
    """(doc, path, tier): auto, assist or human.

    Documents with few hunks and comment-or-blank differences resolve alone; of
    the rest, risky files go to a human and light ones may be assisted. Sides are cut into lines once for all tests, and
    only where the number of hunks does not decide.
    """
    path = F.lower("path")
    rust = path.endswith(".rs")
    hashed = P.any_of(path.endswith(x) for x in HASH_COMMENT_SUFFIXES)
    every = lambda test: F.forall("hunks", test)
    both = lambda h, test: test(h["o"]) & test(h["t"])
    n = F.size("hunks")
    docs = F.startswith("path", F.lit("docs/")) | F.startswith("path", F.lit(".github/")) | path.endswith(".md") | path.endswith(".mdx")
    same = every(lambda h: _comment_free(h["ours"], hashed) == _comment_free(h["theirs"], hashed))
    total = F.aggregate("hunks", F.lit(0), lambda acc, h: acc + F.size(h["o"]) + F.size(h["t"]))
    named = lambda x: (x.contains("type ") & x.contains(" interface")) | x.contains("interface{")
    # the whole side is searched first, so only sides with the word are searched line by line
    interface = lambda side, rows: F.contains(F.lower(side), F.lit("interface")) & F.exists(rows, lambda x: named(F.lower(x)))
    rust_core = lambda s: F.exists(s, lambda x: x.rlike(r"^(trait |pub trait |impl |impl<|unsafe |macro_rules!)"))
    core = F.when(rust, F.exists("hunks", lambda h: rust_core(h["o"]) | rust_core(h["t"]))).otherwise(
        F.exists("hunks", lambda h: interface(h["ours"], h["o"]) | interface(h["theirs"], h["t"]))
    )
    imports = lambda s: _all_lines(s, r'^(import\s+)?(([A-Za-z_][A-Za-z0-9_]*|\.)\s+)?"\S*"\s*(//.*)?$', r"^(\(|\)|//.*)$")
    uses = lambda s: _all_lines(s, r"^use\s+[\w:]+(::\{\s*[\w\s,]+\s*\})?\s*;\s*$", r"^//")
    light = lambda s: _all_lines(s, r"^(alias|import|use) ", r"^$")
    small = lambda s: F.size(s) <= MILD_LINES
    elixir = (path.endswith(".ex") | path.endswith(".exs")) & (n <= WHITELIST_HUNKS) & every(lambda h: both(h, small) & both(h, light))
    mild = (n <= MILD_HUNKS) & every(lambda h: both(h, small))
    assist = mild | every(lambda h: both(h, imports)) | (rust & every(lambda h: both(h, uses))) | elixir
    early = F.when(n == 0, "human").when(docs & (n <= WHITELIST_HUNKS), "auto").when(~docs & same, "auto").when(path.contains("migration") | path.endswith(".sql") | (n > AI_HUNKS), "human")
    tier = F.when((total > AI_LINES) | core, "human").when(assist, "assist").otherwise("human")
    told = hunked.filter("NOT malformed").select("doc", "path", "hunks", early.alias("early"))
    cut = told.withColumn("hunks", F.when(F.col("early").isNull(), _with_lines(F.col("hunks"))))
    return cut.select("doc", "path", F.coalesce("early", tier).alias("tier"))


# -- profiles and overlap ------------------------------------------------------------


def profile_files(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(profile, path); a null profile is an unknown suffix. Files of a profile stay rows."""
    rows = files.select(P.conflict_profile(F.col("path")).alias("profile"), "path").distinct()
    if include:
        rows = rows.filter(F.col("profile").isin(*include))
    if exclude:
        rows = rows.filter(~F.col("profile").isin(*exclude))
    return rows


def overlap(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target, candidate, issue, shared, ratio, advice) of candidate issues against the others of their target.

    files(target, issue, path), candidates(target, issue): the issues one wants to
    start next. Only a candidate's own files are looked up, so the result grows
    with the candidates, not with the square of a target's issues.
    """
    sets = files.select("target", "issue", "path").distinct()
    sizes = sets.groupBy("target", "issue").agg(F.count("*").alias("n"))
    mine = sets.join(candidates.select("target", "issue").distinct(), ["target", "issue"], "left_semi").withColumnRenamed("issue", "candidate")
    shared = mine.join(sets, ["target", "path"]).filter("issue <> candidate").groupBy("target", "candidate", "issue").agg(F.count("*").alias("shared"))
    ratio = F.col("shared") / F.least("n", "n_candidate")
    return (
        shared.join(sizes, ["target", "issue"]).join(sizes.toDF("target", "candidate", "n_candidate"), ["target", "candidate"])
        .select("target", "candidate", "issue", "shared", F.round(ratio, 6).alias("ratio"))
        .withColumn("advice", F.when(F.col("ratio") >= 0.3, "serialise").when(F.col("ratio") > 0.1, "caution").otherwise("parallel"))
    )
