"""Line-level findings: one pass over the lines with every rule as a column expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.functions import text as X
from edgeloom.operators.ordering import positions
from edgeloom.operators.scans import ordered_scan
from edgeloom.session import Scratch

# Scan patterns.
CREDENTIAL_NAMES = (
    "api[_-]?key|secret[_-]?key|auth[_-]?token|password|access[_-]?token|private[_-]?key|client[_-]?secret"
)
ENV_READ = r"(?i)(environ|getenv|env\[|env\.get|ENV\[|System\.get_env|std::env)"
LABEL_VALUE = r"""[=:]\s*["']([^"']+)["']"""
INJECTION = r"""(?i)\b(cursor\.execute|db\.query|conn\.execute|session\.execute|\.raw_query|\.run_query|os\.system|subprocess\.call|Runtime\.exec)\s*\([^)]*(\+|\.format\(|f["']|\$\{|#\{)"""
UNSAFE_LOAD = r"(?i)\b(pickle\.loads?\s*\(|yaml\.load\s*\(|marshal\.loads?\s*\(|shelve\.open\s*\(|jsonpickle\.decode\s*\()"
SAFE_LOAD = r"(?i)yaml\.safe_load"
EVAL_CALL = r"(?i)\beval\s*\("
WEAK_CRYPTO = r"""(?i)\b(hashlib\.md5|hashlib\.sha1|MD5\.new|SHA1\.new|DES\.new|RC4\.new|Digest::MD5|Digest::SHA1|md5\(|sha1\(|createHash\s*\(\s*['"](?:md5|sha1)['"])"""
LOG_CALL = r"(?i)\b(logger\.\w+|log\.\w+|console\.log|IO\.inspect|Logger\.\w+|logging\.\w+)\s*\("
SENSITIVE_WORD = r"(?i)(password|passwd|secret|api_key|api_token|auth_token|access_token|private_key|credential)"
LEFTOVER = r"(?i)\b(TODO|FIXME|HACK)\b"
TRIVIAL_CLAUSE = r"^_\s*->\s*(:ok|nil|:error)\s*$"
EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"
DISCARD = r"^\s*let\s+_\s*=\s*.+"
BARE_EXCEPT = r"^\s*except\s*:\s*$"
BROAD_EXCEPT = r"(?i)^\s*except\s+(Exception|BaseException)\b"
RESCUE_INLINE = r"^\s*rescue\s+_\s*->"
RESCUE_ALONE = r"^\s*rescue\s*$"
WILDCARD_CLAUSE = r"^\s*_\s*->"
CATCH_NO_PARAM = r"catch\s*\{"
# Every security pattern contains one of these words (lower case).
SECURITY_WORDS = (
    "token", "key", "password", "secret", "execute", "query", "os.system", "subprocess.call", "runtime.exec", "pickle.load", "yaml.load", "marshal.load",
    "shelve.open", "jsonpickle.decode", "eval", "md5", "sha1", "des.new", "rc4.new", "log", "io.inspect",
)
TRANSLATION_PATHS = ("/i18n/", "/locale", "/lang/", "/translation", "/messages")
SEVERITY_NAMES = {"high": "critical", "medium": "warning", "low": "info"}
COMMENT_RUN = 3


@dataclass(frozen=True)
class Rule:
    """A named test over the columns file, lang, text, next_text and next_code."""

    name: str
    category: str
    severity: str
    confidence: float
    test: Callable[[], Column]


def custom_rule(name: str, predicate: str, category: str = "custom", severity: str = "warning", confidence: float = 1.0) -> Rule:
    """A rule written as a SQL predicate over the line columns."""
    return Rule(name, category, severity, confidence, lambda: F.expr(predicate))


def comment_mark(lang: Column) -> Column:
    return F.when(lang.isin("python", "elixir"), "#").otherwise("//")


def is_comment(text: Column, lang: Column) -> Column:
    return F.startswith(F.trim(text), comment_mark(lang))


def credential(names: str = CREDENTIAL_NAMES) -> Column:
    text, path = F.col("text"), F.lower("file")
    value = F.regexp_extract(text, LABEL_VALUE, 1)
    label = (value != "") & value.rlike(r"^[A-Za-z ?!.,]*$")
    pattern = rf"""(?i)({names})\s*[=:]\s*["'][^"']{{8,}}["']"""
    return text.rlike(pattern) & ~text.rlike(ENV_READ) & ~label & ~P.any_of(path.contains(p) for p in TRANSLATION_PATHS)


def _swallowed() -> Column:
    text, lang, trimmed = F.col("text"), F.col("lang"), F.trim("text")
    body = F.trim(F.regexp_replace(trimmed, r"^(rescue)+", ""))
    python = (lang == "python") & trimmed.startswith("except") & trimmed.endswith(":") & F.trim("next_code").isin("pass", "...")
    elixir = (lang == "elixir") & trimmed.startswith("rescue") & (
        body.rlike(TRIVIAL_CLAUSE) | ((body == "") & F.trim("next_text").rlike(TRIVIAL_CLAUSE))
    )
    script = lang.isin("typescript", "javascript") & trimmed.rlike(EMPTY_CATCH)
    return ((lang == "rust") & text.rlike(DISCARD)) | F.coalesce(python, F.lit(False)) | F.coalesce(elixir, F.lit(False)) | script


def _broad() -> Column:
    text, lang = F.col("text"), F.col("lang")
    python = (lang == "python") & (text.rlike(BARE_EXCEPT) | text.rlike(BROAD_EXCEPT))
    alone = text.rlike(RESCUE_ALONE) & F.coalesce(F.col("next_text").rlike(WILDCARD_CLAUSE), F.lit(False))
    elixir = (lang == "elixir") & (text.rlike(RESCUE_INLINE) | alone)
    return python | elixir | (lang.isin("typescript", "javascript") & text.rlike(CATCH_NO_PARAM))


def security_rules(names: str = CREDENTIAL_NAMES) -> list[Rule]:
    text = lambda: F.col("text")
    return [
        Rule("hardcoded_credential", "security", "critical", 0.7, lambda: credential(names)),
        Rule("injection_risk", "security", "critical", 0.7, lambda: text().rlike(INJECTION)),
        Rule("unsafe_deserialization", "security", "critical", 0.9, lambda: text().rlike(UNSAFE_LOAD) & ~text().rlike(SAFE_LOAD)),
        Rule("injection_risk", "security", "critical", 0.9, lambda: text().rlike(EVAL_CALL) & ~text().rlike(UNSAFE_LOAD)),
        Rule("weak_crypto", "security", "warning", 0.9, lambda: text().rlike(WEAK_CRYPTO)),
        Rule("sensitive_data_log", "security", "warning", 0.5, lambda: text().rlike(LOG_CALL) & text().rlike(SENSITIVE_WORD)),
    ]


def line_rules(names: str = CREDENTIAL_NAMES) -> list[Rule]:
    """All line rules; the last two need next_text and next_code (see :func:`with_next`)."""
    return security_rules(names) + [
        Rule("leftover_boilerplate", "noise", "info", 0.9, lambda: is_comment(F.col("text"), F.col("lang")) & F.col("text").rlike(LEFTOVER)),
        Rule("swallowed_error", "error_handling", "critical", 0.9, _swallowed),
        Rule("broad_catch", "error_handling", "warning", 0.9, _broad),
    ]


def near_handlers() -> Column:
    """Lines that a rule with next_text or next_code can hit: all others are judged by themselves."""
    text, lang = F.trim("text"), F.col("lang")
    return ((lang == "python") & text.startswith("except")) | ((lang == "elixir") & text.startswith("rescue"))


def with_next(lines: DataFrame, **split) -> DataFrame:
    """Adds next_text (the following line) and next_code (the next line that is neither blank nor comment)."""
    back = lines.withColumn("_back", -F.col("line"))
    code = F.when((F.trim("text") != "") & ~is_comment(F.col("text"), F.col("lang")), F.col("text"))
    return ordered_scan(
        back, ["file"], "_back", prev={"next_text": "text"}, last_before={"next_code": code}, **split
    ).drop("_back")


def scan(lines: DataFrame, rules: list[Rule], categories: set[str] | None = None) -> DataFrame:
    """(file, line, rule, category, severity, confidence, code): every rule hit of non-test files.

    All rules are one projection over one scan of the lines.
    """
    used = [r for r in rules if categories is None or r.category in categories]
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    r.test(),
                    F.struct(
                        F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence")
                    ),
                )
                for r in used
            ]
        )
    )
    kept = lines.filter(~P.is_test(F.col("file")))
    return kept.select("file", "line", F.explode(hits).alias("h"), F.trim("text").alias("code")).select("file", "line", "h.*", "code")


def scan_lines(lines: DataFrame, rules: list[Rule], categories: set[str] | None = None) -> DataFrame:
    """:func:`scan` with all of :func:`line_rules`: only files that hold a handler line are ordered to find what follows it.

    All other lines are judged where they are read, without a shuffle.
    """
    handler = F.coalesce(near_handlers(), F.lit(False))
    files = lines.filter(handler).select("file").distinct()
    followed = with_next(lines.join(files, "file", "left_semi")).filter(handler)
    nothing = F.lit(None).cast("string")
    alone = lines.filter(~handler).withColumns({"next_text": nothing, "next_code": nothing})
    return scan(alone.unionByName(followed), rules, categories)


def document_lines(docs: DataFrame, patterns: list[str], words: tuple[str, ...] = ()) -> DataFrame:
    """Lines (file, line, text, lang) of docs(file, text, lang) that can match at all.

    The whole text is tested first, so clean documents are never exploded: plain
    substring search for ``words`` (each pattern must need one of them), then the patterns.
    """
    any_hit = P.any_of(F.col("text").rlike(p) for p in patterns)
    # the one-element array makes the lower-cased text a bound value, computed once for all words
    any_word = F.exists(F.array(F.lower("text")), lambda x: P.any_of(x.contains(w) for w in words)) if words else F.lit(True)
    return docs.filter(any_word).filter(any_hit).select("file", "lang", F.posexplode(X.lines(F.col("text"))).alias("pos", "text")).select(
        "file", (F.col("pos") + 1).cast("bigint").alias("line"), "text", "lang"
    )


def trivial_comments(lines: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Comments nearly equal to the next code line."""
    bare = F.trim(F.regexp_replace("text", r"^\s*(#|//)+", ""))
    a, b = X.compare_form(bare), X.compare_form(F.col("next_code"))
    near = X.similarity(F.col("a"), F.col("b"))
    return (
        with_next(lines).filter(is_comment(F.col("text"), F.col("lang")))
        .select("file", "line", a.alias("a"), b.alias("b"))
        .filter((F.col("a") != "") & (F.col("b") != "") & X.may_resemble(F.col("a"), F.col("b"), threshold))
        .select("file", "line", F.round(near, 6).alias("similarity"))
        .filter(F.col("similarity") > threshold)
    )


def commented_code(lines: DataFrame, ratio: float = 0.5, **split) -> DataFrame:
    """(file, line, lines, code_lines): runs of three or more comment lines that mostly look like code.

    Whether a run is code is judged by the share of lines with code punctuation.
    """
    comment = is_comment(F.col("text"), F.col("lang"))
    numbered = ordered_scan(
        lines.withColumn("c", comment.cast("int")), ["file"], "line", running={"breaks": 1 - F.col("c")}, **split
    )
    looks = F.col("text").rlike(r"[;{}=]|\w\(")
    runs = numbered.filter("c = 1").groupBy("file", "breaks").agg(
        F.min("line").alias("line"), F.count("*").alias("lines"), F.count_if(looks).alias("code_lines")
    )
    return runs.filter((F.col("lines") >= COMMENT_RUN) & (F.col("code_lines") >= F.col("lines") * ratio)).select("file", "line", "lines", "code_lines")


def snippets(lines: DataFrame, hits: DataFrame, around: int = 2) -> DataFrame:
    """(file, line, snippet): numbered context of distinct hit positions; the hit line is marked."""
    wanted = hits.select("file", F.col("line").alias("at")).distinct().select(
        "file", "at", F.explode(F.sequence(F.col("at") - around, F.col("at") + around)).alias("line")
    )
    shown = F.concat(F.when(F.col("line") == F.col("at"), "> ").otherwise("  "), F.col("line").cast("string"), F.lit(": "), F.col("text"))
    return (
        wanted.join(lines.select("file", "line", "text"), ["file", "line"])
        .groupBy("file", F.col("at"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", shown.alias("s")))), lambda r: r["s"]), "\n").alias("snippet"))
        .withColumnRenamed("at", "line")
    )


def _merged(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """An equi join that is never a broadcast: functions grow with the files, and a written table of short columns is
    many times larger in the driver's memory than on disk, by which Spark would judge it."""
    return left.join(right.hint("merge"), keys, how)


def _dyadic(functions: DataFrame) -> DataFrame:
    """(file, level, node, best): the smallest function over each dyadic interval [node * 2^level, (node + 1) * 2^level).

    A function of n lines is the union of at most 2 log2(n) such intervals, two of a level at most.
    """
    size = F.col("end_line") - F.col("start_line")
    best = F.struct(size.alias("size"), F.negative("start_line").alias("s"), F.col("func"))
    levels = functions.filter(size >= 0).select("file", "start_line", "end_line", best.alias("best"), F.explode(F.expr("sequence(0, length(bin(end_line - start_line + 1)))")).alias("level"))
    low, high = "shiftright(start_line + shiftleft(1L, level) - 1, level)", "shiftright(end_line + 1, level)"
    left = f"if({low} < {high} and {low} & 1 = 1, {low}, null)"
    right = f"if({low} + ({low} & 1) < {high} and {high} & 1 = 1, {high} - 1, null)"
    nodes = levels.select("file", "level", "best", F.explode(F.expr(f"filter(array({left}, {right}), x -> x is not null)")).alias("node"))
    return nodes.groupBy("file", "level", "node").agg(F.min("best").alias("best"))


def owners(points: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, line, func, start_line): the smallest function around each of points(file, line); lines of no function drop.

    Ties of size go to the later start, then by name. A point meets its one interval of every level that its file has, by
    an equi join, so neither lines nor functions are spread out.
    """
    nodes = _dyadic(functions)
    heights = nodes.groupBy("file").agg(F.max("level").alias("top"))
    keyed = _merged(points.select("file", "line"), heights, "file").withColumn("level", F.explode(F.sequence(F.lit(0), "top")))
    keyed = keyed.withColumn("node", F.expr("shiftright(line, level)"))
    best = _merged(keyed, nodes, ["file", "level", "node"]).groupBy("file", "line").agg(F.min("best").alias("b"))
    return best.select("file", "line", F.col("b.func").alias("func"), (-F.col("b.s")).alias("start_line"))


def _stretches(functions: DataFrame) -> DataFrame:
    """(file, line, until, func, start_line): runs of lines with one smallest function, at most two for each function."""
    edges = functions.filter("end_line >= start_line").select("file", F.explode(F.array(F.col("start_line"), F.col("end_line") + 1)).alias("line")).distinct()
    runs = edges.withColumn("until", F.lead("line").over(Window.partitionBy("file").orderBy("line")) - 1)
    return _merged(owners(edges, functions), runs, ["file", "line"])


def innermost(functions: DataFrame) -> DataFrame:
    """(file, line, func, start_line): the smallest function around every covered line."""
    return _stretches(functions).select("file", F.explode(F.sequence("line", "until")).alias("line"), "func", "start_line")


def comment_density(lines: DataFrame, functions: DataFrame, comment: Column, threshold: float = 0.5, min_lines: int = 3) -> DataFrame:
    """Functions whose own comment/code ratio is above the threshold; nested functions count for themselves."""
    own = _stretches(functions).groupBy("file", "func", "start_line").agg(F.sum(F.col("until") - F.col("line") + 1).alias("own"))
    noted = owners(lines.filter(comment), functions).groupBy("file", "func", "start_line").agg(F.count("*").alias("comments"))
    counts = _merged(own, noted, ["file", "func", "start_line"], "left").withColumn("comments", F.coalesce("comments", F.lit(0)))
    long_enough = functions.filter(F.col("end_line") - F.col("start_line") + 1 >= min_lines).select("file", "func", "start_line")
    code = F.col("own") - F.col("comments")
    ratio = F.col("comments") / code
    return (
        _merged(counts, long_enough, ["file", "func", "start_line"], "left_semi")
        .filter(code > 0)
        .withColumn("ratio", ratio)
        .filter(F.col("ratio") > threshold)
        .select("file", "func", F.col("start_line").alias("line"), F.round("ratio", 6).alias("ratio"), F.round(0.5 + F.least("ratio", F.lit(1.0)) * 0.5, 6).alias("confidence"))
    )


def lines_in_functions(points: DataFrame, functions: DataFrame, bucket: int = 64) -> DataFrame:
    """points(file, line_no) joined to functions(file, func, start_line, length) with start <= line < start + length.

    Ranges are cut into line buckets, so the join is an equi join on (file, bucket).
    """
    last = F.col("start_line") + F.col("length") - 1
    cut = functions.filter("length > 0").select(
        "file", "func", "start_line", "length",
        F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(last / bucket))).alias("bucket"),
    )
    keyed = points.withColumn("bucket", F.floor(F.col("line_no") / bucket))
    return keyed.join(cut, ["file", "bucket"]).filter("line_no >= start_line AND line_no < start_line + length").drop("bucket")


def unused_imports(imports: DataFrame, used: DataFrame) -> DataFrame:
    """imports(file, specifier, kind) whose name and last segment are not among used(file, name)."""
    rows = imports.filter(~F.col("kind").isin("use", "behaviour") & (F.trim("specifier") != "")).select("file", F.trim("specifier").alias("specifier"))
    names = used.select("file", "name").distinct()
    short = F.element_at(F.split("specifier", r"\."), -1)
    return (
        rows.join(names.withColumnRenamed("name", "specifier"), ["file", "specifier"], "left_anti")
        .withColumn("name", short)
        .join(names, ["file", "name"], "left_anti")
        .select("file", "specifier")
    )


def _compatible() -> Column:
    """Type pairs by language are fixed values."""
    ann, guard, lang = F.trim("type_expr"), F.trim("guarded_type"), F.col("lang")
    ts = lang.isin("typescript", "tsx") & (guard == "Array") & (ann.endswith("[]") | ann.startswith("Array"))
    option = (guard == "Some") & (ann.startswith("Option") | ann.startswith("&Option"))
    result = guard.isin("Ok", "Err") & (ann.startswith("Result") | ann.startswith("&Result"))
    borrowed = (ann == "&str") & (guard == "str")
    return (ann == guard) | ts | ((lang == "rust") & (option | result | borrowed))


def redundant_type_checks(annotations: DataFrame, guards: DataFrame) -> DataFrame:
    """annotations(file, func, param, type_expr, lang) met by guards(file, func, param, guarded_type, line)."""
    soft = F.col("lang") == "elixir"
    return (
        annotations.join(guards, ["file", "func", "param"]).filter(_compatible())
        .select(
            "file", "line", "func", "param", F.lit("redundant_type_check").alias("rule"),
            F.when(soft, "warning").otherwise("critical").alias("severity"), F.when(soft, 0.7).otherwise(0.9).alias("confidence"),
        )
    )


def unnecessary_defaults(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """Required fields(file, name, required) read by calls(file, line, callee, args) as ``get(name, default)``."""
    getter = (F.endswith("callee", F.lit(".get")) | (F.col("callee") == "get")) & (F.size("args") >= 2)
    read = calls.filter(getter).select("file", "line", F.col("args")[0].alias("name"))
    return read.join(fields.filter("required").select("file", "name"), ["file", "name"]).select("file", "line", "name").distinct()


def merge_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_reports(reports: DataFrame, external: DataFrame) -> DataFrame:
    """Per-file reports (file, total, by_severity, by_category) with external findings counted in.

    reports has one row per analysed file, also where nothing was found; external(file, severity, category) may name
    files without a report, which get one. The maps hold counts of at least 1; severities and categories stay as named.
    Findings are counted by file and name before they meet the reports, so a file with most findings is no hot key.
    """
    counts = lambda c: external.groupBy("file", F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(c))
    old = lambda c, m: reports.select("file", F.explode(m).alias("name", "n"), F.lit(c).alias("kind"))
    parts = counts("severity").unionByName(counts("category")).unionByName(old("severity", "by_severity")).unionByName(old("category", "by_category"))
    merged = parts.groupBy("file", "kind", "name").agg(F.sum("n").alias("n"))
    pairs = lambda c: F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("name", "n"))))
    told = merged.groupBy("file").agg(pairs("severity").alias("s"), pairs("category").alias("c"), F.sum(F.when(F.col("kind") == "severity", F.col("n"))).alias("total"))
    every = reports.select("file").unionByName(external.select("file")).distinct()
    empty = F.expr("cast(map() as map<string, bigint>)")
    return every.join(told, "file", "left").select(
        "file", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.map_from_entries("s"), empty).alias("by_severity"), F.coalesce(F.map_from_entries("c"), empty).alias("by_category"),
    )


def reports(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, total, by_severity, by_category) of files(file), one row each, and of findings(file, severity, category)."""
    none = F.expr("cast(map() as map<string, bigint>)")
    return merge_reports(files.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("total"), none.alias("by_severity"), none.alias("by_category")), findings)


def severity(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_NAMES.items() for x in kv])
    return F.coalesce(table[name], name)


def file_summary(findings: DataFrame) -> DataFrame:
    """(file, total, critical, warning, info) with old severity names migrated."""
    s = severity(F.col("severity"))
    return findings.groupBy("file").agg(
        F.count("*").alias("total"), *[F.count_if(s == n).alias(n) for n in ("critical", "warning", "info")]
    )


def category_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file", "category").agg(F.count("*").alias("n"))


def gate(findings: DataFrame) -> DataFrame:
    """One row: counts by severity and exit code (1 with any finding)."""
    s = severity(F.col("severity"))
    return findings.agg(
        *[F.count_if(s == n).alias(n) for n in ("critical", "warning", "info")], F.when(F.count("*") > 0, 1).otherwise(0).alias("code")
    )


def _order() -> list:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return [rank, "file", "line"]


def _written(findings: DataFrame) -> DataFrame:
    """A range exchange samples its rows before it deals them; written findings are read twice, not found twice."""
    return Scratch(findings.sparkSession, "findings").save(findings, "findings")


def ordered(findings: DataFrame) -> DataFrame:
    """Critical, warning, info, then file and line."""
    return _written(findings).orderBy(*_order())


def ranked(findings: DataFrame) -> DataFrame:
    """The same order as a column ``place`` from 1; findings of one line follow their rule. No task sees all rows."""
    return positions(_written(findings), [], [*_order(), "rule"], "place")
