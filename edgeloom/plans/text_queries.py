"""Snapshots, text scans, clones, scenario lint and document coverage over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.functions import paths as P
from edgeloom.functions import text as X
from edgeloom.operators import clones as K
from edgeloom.operators import coverage as V
from edgeloom.operators import findings as D
from edgeloom.operators import relations as R
from edgeloom.plans.registry import query
from edgeloom.session import Scratch
from edgeloom.sources import documents as S
from edgeloom.sources import records as J


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def m(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {q(pattern)})"


# -- snapshots ---------------------------------------------------------------------


def snapshot_texts(t):
    """JSON texts in the three accepted shapes, one file record per order."""
    line = t("lineitem")
    rec = line.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "N", F.concat(F.lit("parts\\"), F.col("l_partkey").cast("string"))))).alias("localDependencies"),
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "N", F.concat(F.lit("parts/"), F.col("l_partkey").cast("string"))))).alias("localCallTargets"),
    )
    doc = rec.select("l_orderkey", F.struct(F.concat(F.lit("orders\\"), F.col("l_orderkey").cast("string")).alias("sourcePath"), "localDependencies", "localCallTargets").alias("r"))
    k = F.col("l_orderkey") % 3
    return doc.select(
        F.when(k == 0, F.to_json(F.array("r"))).when(k == 1, F.to_json("r")).otherwise(F.to_json(F.struct(F.array("r").alias("records")))).alias("value")
    )


query(
    "snapshot_references",
    """SELECT 'orders/' || CAST(l_orderkey AS VARCHAR) AS src_path, 'parts/' || CAST(l_partkey AS VARCHAR) AS dst_path,
      CASE WHEN l_returnflag = 'N' THEN 'import' ELSE 'call' END AS kind FROM lineitem""",
)(lambda t: J.references(J.parse_records(snapshot_texts(t))))
query(
    "page_links",
    """SELECT url AS src_path, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst_path, 'import' AS kind FROM pages""",
)(lambda t: J.page_links(t("pages")))
query(
    "distinct_calls",
    """SELECT 'ord/' || CAST(l_orderkey AS VARCHAR) AS path, 'run ' || l_returnflag || ' ' || l_linestatus AS callee FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus""",
)(
    lambda t: J.distinct_calls(
        t("lineitem").groupBy(F.concat(F.lit("ord/"), F.col("l_orderkey").cast("string")).alias("sourcePath")).agg(
            F.collect_list(F.struct(F.concat(F.lit(" run  "), "l_returnflag", F.lit(" "), "l_linestatus").alias("callee"))).alias("calls")
        )
    )
)
query(
    "distinct_imports",
    """SELECT DISTINCT 'ord/' || CAST(l_orderkey AS VARCHAR) AS path, l_returnflag AS kind, 'pkg ' || l_linestatus AS specifier FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_linenumber % 3 <> 0""",
)(
    lambda t: J.distinct_imports(
        t("lineitem").groupBy(F.concat(F.lit("ord/"), F.col("l_orderkey").cast("string")).alias("sourcePath")).agg(
            F.collect_list(
                F.struct(
                    F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit(" pkg \t "), "l_linestatus", F.lit("\n"))).alias("specifier"),
                    F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "l_returnflag")).alias("kind"),
                )
            ).alias("imports")
        )
    )
)
query(
    "first_calls",
    """SELECT l_orderkey AS file, l_returnflag AS callee, l_linenumber AS line, l_partkey AS target FROM lineitem
      QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) = 1""",
)(lambda t: J.first_calls(t("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("callee"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("target"))))
SPELL = """
tg AS (SELECT o_orderkey AS source, CASE o_orderkey % 4 WHEN 0 THEN 'src/c' WHEN 1 THEN './c' WHEN 2 THEN 'c' ELSE 'lost/c' END || CAST(o_custkey AS VARCHAR) AS target FROM orders),
kn AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'src/c' ELSE './c' END || CAST(c_custkey AS VARCHAR) AS path FROM customer),
tries AS (SELECT source, target, unnest([target, './' || target, regexp_replace(target, '^(\\./)+', ''), 'src/' || target, regexp_replace(target, '^(src/)+', '')]) AS path, unnest([0, 1, 2, 3, 4]) AS pos FROM tg)
"""


def spelling_inputs(t):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    head = F.when(k == 0, "src/c").when(k == 1, "./c").when(k == 2, "c").otherwise("lost/c")
    refs = t("orders").select(F.col("o_orderkey").alias("source"), F.concat(head, c).alias("target"))
    j = F.col("c_custkey") % 3
    known = t("customer").select(F.concat(F.when(j == 0, "c").when(j == 1, "src/c").otherwise("./c"), F.col("c_custkey").cast("string")).alias("path"))
    return refs, known


query("resolved_module_targets", "SELECT source, target, arg_min(t.path, pos) AS resolved FROM tries t JOIN kn ON kn.path = t.path GROUP BY source, target", SPELL)(
    lambda t: R.resolve_candidates(*spelling_inputs(t), R.module_spellings(F.col("target"))).select("source", "target", "resolved")
)
CALLS = SPELL.replace("unnest([target, './' || target, regexp_replace(target, '^(\\./)+', ''), 'src/' || target, regexp_replace(target, '^(src/)+', '')]) AS path, unnest([0, 1, 2, 3, 4])",
                      "unnest([target || '#file#1', regexp_replace(target, '^(\\./src/)+', '') || '#file#1', regexp_replace(target, '^(src/)+', '') || '#file#1', target]) AS path, unnest([0, 1, 2, 3])")
query(
    "resolved_call_targets",
    "SELECT source, target, arg_min(t.path, pos) AS resolved FROM tries t JOIN kf ON kf.path = t.path GROUP BY source, target",
    CALLS + ", kf AS (SELECT path || '#file#1' AS path FROM kn)",
)(
    lambda t: R.resolve_candidates(
        spelling_inputs(t)[0], spelling_inputs(t)[1].select(F.concat("path", F.lit("#file#1")).alias("path")), R.call_spellings(F.col("target"))
    ).select("source", "target", "resolved")
)
query(
    "resolved_packages",
    """SELECT specifier, arg_max(target, length(package)) AS resolved FROM specs JOIN packs ON specifier = package OR starts_with(specifier, package || '/') GROUP BY specifier""",
    """specs AS (SELECT DISTINCT '@' || lower(p_type) || '/' || replace(p_name, ' ', '/') || '/x' || CAST(p_size AS VARCHAR) AS specifier FROM part),
    packs AS (SELECT DISTINCT '@' || lower(p_type) || '/' || split_part(p_name, ' ', 1) AS package, 'pkg_' || split_part(p_name, ' ', 1) AS target FROM part
      UNION SELECT DISTINCT '@' || lower(p_type), 'root_' || lower(p_type) FROM part WHERE p_size < 10)""",
)(
    lambda t: R.resolve_package_imports(
        t("part").select(F.concat(F.lit("@"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/x"), F.col("p_size").cast("string")).alias("specifier")),
        t("part").select(F.concat(F.lit("@"), F.lower("p_type"), F.lit("/"), F.split("p_name", " ")[0]).alias("package"), F.concat(F.lit("pkg_"), F.split("p_name", " ")[0]).alias("target"))
        .union(t("part").filter("p_size < 10").select(F.concat(F.lit("@"), F.lower("p_type")), F.concat(F.lit("root_"), F.lower("p_type")))).distinct(),
    )
)
ALIAS = """
al AS (SELECT p_partkey AS source, p_size AS k, 'App.' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS base FROM part),
names AS (SELECT source, base || '.Store' AS name FROM al WHERE k % 3 = 0 UNION SELECT source, base || '.Entry' FROM al WHERE k % 3 = 0 UNION SELECT source, base FROM al WHERE k % 3 = 1 UNION SELECT source, 'Other.Entry' FROM al WHERE k % 3 = 2),
mods AS (SELECT DISTINCT base AS name, 'lib/' || lower(base) || '.ex' AS path FROM al UNION SELECT DISTINCT base || '.Entry', 'lib/' || lower(base) || '/entry.ex' FROM al)
"""


def alias_inputs(t):
    base = F.concat(F.lit("App."), F.upper(F.substring("p_type", 1, 1)), F.lower(F.substr("p_type", F.lit(2))))
    k = F.col("p_size") % 3
    spec = F.when(k == 0, F.concat(base, F.lit(".{Store, Entry, as: E}"))).when(k == 1, F.concat(base, F.lit(", as: B"))).otherwise("Other.Entry, only: [get: 1]")
    names = t("part").select(F.col("p_partkey").alias("source"), F.explode(R.expand_aliases(F.regexp_replace(spec, ", as: E}", "}"))).alias("name"))
    mods = t("part").select(base.alias("name")).distinct()
    mods = mods.select("name", F.concat(F.lit("lib/"), F.lower("name"), F.lit(".ex")).alias("path")).union(
        mods.select(F.concat("name", F.lit(".Entry")), F.concat(F.lit("lib/"), F.lower("name"), F.lit("/entry.ex")))
    )
    return names, mods


query(
    "resolved_aliases",
    """SELECT n.source, n.name, COALESCE(f.path, s.path) AS path FROM names n LEFT JOIN mods f ON f.name = n.name
    LEFT JOIN (SELECT split_part(name, '.', -1) AS short, MIN(path) AS path FROM mods GROUP BY 1) s ON s.short = split_part(n.name, '.', -1) WHERE COALESCE(f.path, s.path) IS NOT NULL""",
    ALIAS,
)(lambda t: R.resolve_names(*alias_inputs(t)))
query(
    "module_references",
    r"""SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, regexp_extract(raw, '^([A-Z][A-Za-z0-9_]*(?:\.[A-Z][A-Za-z0-9_]*)+)', 1) AS ref
      FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, '. ', '.'), '([A-Z][A-Za-z0-9_.]*)', 1)) AS raw FROM documents)) WHERE ref <> ''""",
)(lambda t: t.wide("documents").select("doc_id", F.explode(R.module_refs(F.replace("text", F.lit(". "), F.lit(".")))).alias("ref")))
REF_SQL = r"""
rf AS (SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, regexp_extract(raw, '^([A-Z][A-Za-z0-9_]*(?:\.[A-Z][A-Za-z0-9_]*)+)', 1) AS ref
  FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, '. ', '.'), '([A-Z][A-Za-z0-9_.]*)', 1)) AS raw FROM documents)) WHERE ref <> ''),
hd AS (SELECT doc_id, ref, n, array_to_string(string_split(ref, '.')[1:n], '.') AS name FROM (SELECT doc_id, ref, unnest(range(2, len(string_split(ref, '.')) + 1)) AS n FROM rf)),
nm AS (SELECT DISTINCT name, CASE n WHEN 2 THEN 'two' ELSE 'three' END || CAST(length(name) AS VARCHAR) AS module FROM hd WHERE n <= 3 AND length(name) % 3 <> n - 2)
"""


def known_names(t):
    """Two and three leading segments of names that the documents hold, some left out."""
    refs = t.wide("documents").select(F.explode(R.module_refs(F.replace("text", F.lit(". "), F.lit(".")))).alias("ref")).distinct()
    head = lambda n: F.array_join(F.slice(F.split("ref", r"\."), 1, n), ".").alias("name")
    two = refs.select(head(2), F.lit("two").alias("kind")).filter("length(name) % 3 <> 0")
    three = refs.filter(F.size(F.split("ref", r"\.")) >= 3).select(head(3), F.lit("three").alias("kind")).filter("length(name) % 3 <> 1")
    return two.unionByName(three).distinct().select("name", F.concat("kind", F.length("name").cast("string")).alias("module"))


query("referenced_modules", "SELECT h.doc_id, h.ref, arg_max(m.module, h.n) AS module FROM hd h JOIN nm m ON m.name = h.name GROUP BY h.doc_id, h.ref", REF_SQL)(
    lambda t: R.referenced_modules(t.wide("documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".")).alias("text")), known_names(t), "doc_id")
)
query(
    "side_effect_flags",
    """SELECT page_id, contains(html, 'async ') OR contains(html, 'await ') AS has_async, contains(html, 'fetch(') OR contains(html, 'axios') OR contains(html, 'ky(') AS has_http,
      contains(html, 'fs.') OR contains(html, 'readFile') OR contains(html, 'writeFile') AS has_file_io, contains(html, 'EventEmitter') OR contains(html, '.emit(') AS has_pubsub FROM pages""",
)(lambda t: t("pages").select("page_id", *X.side_effects(F.col("html"))))

# -- paths ---------------------------------------------------------------------------
FILE_PATHS = "fp AS (SELECT DISTINCT path FROM changed_files)"
SUFFIXES = "|".join(P.MODULE_SUFFIXES)
DIRS = ", ".join(f"'{d}'" for d in P.GENERIC_DIRS)
MODULE_SQL = f"""
stem AS (SELECT path, split_part(split_part(path, '/', -1), '.', 1) AS s FROM fp),
bare AS (SELECT path, COALESCE(NULLIF(regexp_extract(s, '^(.+)({SUFFIXES})$', 1), ''), s) AS b FROM stem),
snake AS (SELECT path, lower(substr(b, 1, 1) || regexp_replace(substr(b, 2), '(\\p{{Lu}})', '_\\1', 'g')) AS n FROM bare),
mod_of AS (SELECT path, CASE WHEN n IN ('', 'base', 'index', 'app', 'main') THEN COALESCE(
  list_filter(list_reverse(string_split(lower(path), '/')[1:-2]), lambda x: x <> '' AND x NOT IN ({DIRS}))[1], n) ELSE n END AS module FROM snake)
"""
query(
    "path_facts",
    """SELECT f.path, mo.module, CASE WHEN lower(f.path) LIKE '%controller%' THEN 'controller' WHEN lower(f.path) LIKE '%model%' THEN 'model' WHEN lower(f.path) LIKE '%trait%' THEN 'trait'
      WHEN lower(f.path) LIKE '%service%' THEN 'service' ELSE 'other' END AS kind,
      regexp_matches(f.path, '^(auth/|infra/|deploy/|\\.github/)') OR split_part(f.path, '/', -1) IN ('Dockerfile', 'docker-compose.yml', 'Makefile', '.env', '.env.example') AS high_risk,
      regexp_matches(lower(f.path), '/test/|/tests/|/spec/|_test\\.|\\.test\\.|_spec\\.|\\.spec\\.|^test/|^tests/') AS is_test
    FROM fp f JOIN mod_of mo ON mo.path = f.path""",
    FILE_PATHS + "," + MODULE_SQL,
)(
    lambda t: t("changed_files").select("path").distinct().select(
        "path", P.module_from_path(F.col("path")).alias("module"), P.file_kind(F.col("path")).alias("kind"), P.high_risk(F.col("path")).alias("high_risk"), P.is_test(F.col("path")).alias("is_test")
    )
)
query(
    "source_files",
    """SELECT id, path FROM part_paths WHERE regexp_matches(path, '\\.(ex|exs|go|rs|php|ts|tsx)$') AND NOT regexp_matches(path, '_test\\.')""",
)(lambda t: t("part_paths").filter(P.is_source(F.col("path"))).select("id", "path"))
query(
    "slugs",
    r"""SELECT issue, substr(regexp_replace(regexp_replace(regexp_replace(lower(title || ' ' || body), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '^-|-$', '', 'g'), 1, 30) AS slug FROM issues""",
)(lambda t: t("issues").select("issue", X.slug(F.concat("title", F.lit(" "), "body")).alias("slug")))

query(
    "mapped_modules",
    """SELECT id, CASE WHEN contains(path, 'src/api/') THEN 'web' WHEN contains(path, '/dao/') THEN 'store' WHEN contains(path, 'src/') THEN 'core' END AS module FROM part_paths""",
)(lambda t: t("part_paths").select("id", P.module_of(F.col("path"), {"src/": "core", "src/api/": "web", "/dao/": "store"}).alias("module")))
query("migrated_severities", "SELECT event_id, CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'error' END AS severity FROM event_k")(
    lambda t: t("event_k").select("event_id", D.severity(F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "error")]), (F.col("k") % 4 + 1).cast("int"))).alias("severity"))
)

# -- line findings ---------------------------------------------------------------------
CRED = rf"""(?i)({D.CREDENTIAL_NAMES})\s*[=:]\s*["'][^"']{{8,}}["']"""
LABEL = f"regexp_extract(text, {q(D.LABEL_VALUE)}, 1)"
NOT_TEST = "NOT regexp_matches(lower(file), '/test/|/tests/|/spec/|_test\\.|\\.test\\.|_spec\\.|\\.spec\\.|^test/|^tests/')"
SECURITY = f"""
 SELECT file, line, 'hardcoded_credential' AS rule, 'security' AS category, 'critical' AS severity, 0.7::DOUBLE AS confidence, text FROM {{src}} WHERE {m(CRED)} AND NOT {m(D.ENV_READ)} AND NOT ({LABEL} <> '' AND regexp_matches({LABEL}, '^[A-Za-z ?!.,]*$'))
 UNION ALL SELECT file, line, 'injection_risk', 'security', 'critical', 0.7, text FROM {{src}} WHERE {m(D.INJECTION)}
 UNION ALL SELECT file, line, 'unsafe_deserialization', 'security', 'critical', 0.9, text FROM {{src}} WHERE {m(D.UNSAFE_LOAD)} AND NOT {m(D.SAFE_LOAD)}
 UNION ALL SELECT file, line, 'injection_risk', 'security', 'critical', 0.9, text FROM {{src}} WHERE {m(D.EVAL_CALL)} AND NOT {m(D.UNSAFE_LOAD)}
 UNION ALL SELECT file, line, 'weak_crypto', 'security', 'warning', 0.9, text FROM {{src}} WHERE {m(D.WEAK_CRYPTO)}
 UNION ALL SELECT file, line, 'sensitive_data_log', 'security', 'warning', 0.5, text FROM {{src}} WHERE {m(D.LOG_CALL)} AND {m(D.SENSITIVE_WORD)}
"""
ALL_RULES = f"""
cm AS (SELECT *, starts_with(trim(text), CASE WHEN lang IN ('python', 'elixir') THEN '#' ELSE '//' END) AS c FROM code_lines),
nx AS (SELECT *, LEAD(text) OVER w AS next_text, FIRST_VALUE(CASE WHEN trim(text) <> '' AND NOT c THEN text END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_code
  FROM cm WINDOW w AS (PARTITION BY file ORDER BY line)),
hit AS ({SECURITY.replace('{src}', 'cm')}
 UNION ALL SELECT file, line, 'leftover_boilerplate', 'noise', 'info', 0.9, text FROM cm WHERE c AND {m(D.LEFTOVER)}
 UNION ALL SELECT file, line, 'swallowed_error', 'error_handling', 'critical', 0.9, text FROM nx WHERE
   (lang = 'rust' AND {m(D.DISCARD)}) OR (lang = 'python' AND starts_with(trim(text), 'except') AND ends_with(trim(text), ':') AND trim(next_code) IN ('pass', '...'))
   OR (lang = 'elixir' AND starts_with(trim(text), 'rescue') AND (regexp_matches(trim(regexp_replace(trim(text), '^(rescue)+', '')), {q(D.TRIVIAL_CLAUSE)})
       OR (trim(regexp_replace(trim(text), '^(rescue)+', '')) = '' AND regexp_matches(trim(next_text), {q(D.TRIVIAL_CLAUSE)}))))
   OR (lang = 'typescript' AND {m(D.EMPTY_CATCH)})
 UNION ALL SELECT file, line, 'broad_catch', 'error_handling', 'warning', 0.9, text FROM nx WHERE
   (lang = 'python' AND ({m(D.BARE_EXCEPT)} OR {m(D.BROAD_EXCEPT)})) OR (lang = 'elixir' AND ({m(D.RESCUE_INLINE)} OR ({m(D.RESCUE_ALONE)} AND COALESCE({m(D.WILDCARD_CLAUSE, 'next_text')}, FALSE))))
   OR (lang = 'typescript' AND {m(D.CATCH_NO_PARAM)}))
"""


def all_findings(t):
    return D.scan_lines(t.wide("code_lines"), D.line_rules())


query("line_findings", f"SELECT file, line, rule, category, severity, confidence, trim(text) AS code FROM hit WHERE {NOT_TEST}", ALL_RULES)(all_findings)
query("custom_findings", "SELECT file, line, 'long_call' AS rule, 'custom' AS category, 'warning' AS severity, 1.0::DOUBLE AS confidence, trim(text) AS code FROM code_lines WHERE length(text) > 16 AND contains(text, '(')")(
    lambda t: D.scan(t("code_lines"), [D.custom_rule("long_call", "length(text) > 16 AND contains(text, '(')")])
)
query("security_findings", f"SELECT file, line, rule, category, severity, confidence, trim(text) AS code FROM hit WHERE {NOT_TEST} AND category = 'security'", ALL_RULES)(
    lambda t: D.scan(t.wide("code_lines"), D.line_rules(), {"security"})
)
query(
    "finding_file_summary",
    "SELECT file, COUNT(*) AS total, COUNT(*) FILTER (WHERE severity = 'critical') AS critical, COUNT(*) FILTER (WHERE severity = 'warning') AS warning, COUNT(*) FILTER (WHERE severity = 'info') AS info FROM hit GROUP BY file",
    ALL_RULES,
)(lambda t: D.file_summary(all_findings(t)))
query("finding_categories", "SELECT file, category, COUNT(*) AS n FROM hit GROUP BY file, category", ALL_RULES)(lambda t: D.category_summary(all_findings(t)))
query(
    "finding_gate",
    "SELECT COUNT(*) FILTER (WHERE severity = 'critical') AS critical, COUNT(*) FILTER (WHERE severity = 'warning') AS warning, COUNT(*) FILTER (WHERE severity = 'info') AS info, CASE WHEN COUNT(*) > 0 THEN 1 ELSE 0 END AS code FROM hit",
    ALL_RULES,
)(lambda t: D.gate(all_findings(t)))
query("ordered_findings", "SELECT file, line, rule, severity FROM hit", ALL_RULES)(lambda t: D.ordered(all_findings(t).select("file", "line", "rule", "severity")))
query(
    "ranked_findings",
    """SELECT file, line, rule, severity, ROW_NUMBER() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, file, line, rule) AS place FROM hit""",
    ALL_RULES,
)(lambda t: D.ranked(all_findings(t).select("file", "line", "rule", "severity")))
DOC_LINES = """
dl AS (SELECT file, i AS line, lang, ls[i] AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS file, lang, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))
"""
TOKEN = rf"""(?i)(token|{D.CREDENTIAL_NAMES})\s*[=:]\s*["'][^"']{{8,}}["']"""


def doc_findings(t):
    docs = t.wide("documents").select(F.col("doc_id").cast("string").alias("file"), "text", "lang")
    rules = D.security_rules("token|" + D.CREDENTIAL_NAMES)
    patterns = [TOKEN, D.INJECTION, D.UNSAFE_LOAD, D.EVAL_CALL, D.WEAK_CRYPTO, D.LOG_CALL]
    return D.scan(D.document_lines(docs, patterns, D.SECURITY_WORDS), rules)


def found_snippets(t, hits):
    """Snippets of written hits: the documents' rules run once."""
    docs = t.wide("documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return D.snippets(S.numbered_lines(docs.join(hits, "file", "left_semi"), "file"), hits)


query(
    "document_findings",
    f"SELECT file, line, rule, category, severity, confidence, trim(text) AS code FROM ({SECURITY.replace('{src}', 'dl').replace(m(CRED), m(TOKEN))})",
    DOC_LINES,
)(doc_findings)
query(
    "finding_snippets",
    f"""SELECT h.file, h.line, string_agg(CASE WHEN l.line = h.line THEN '> ' ELSE '  ' END || CAST(l.line AS VARCHAR) || ': ' || l.text, chr(10) ORDER BY l.line) AS snippet
    FROM (SELECT DISTINCT file, line FROM ({SECURITY.replace('{src}', 'dl').replace(m(CRED), m(TOKEN))})) h JOIN dl l ON l.file = h.file AND l.line BETWEEN h.line - 2 AND h.line + 2 GROUP BY h.file, h.line""",
    DOC_LINES,
)(
    lambda t: found_snippets(t, Scratch(t.spark, "hits").save(doc_findings(t).select("file", "line").distinct(), "hits"))
)
NORMAL = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
query(
    "trivial_comments",
    f"""SELECT file, line, ROUND(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS similarity FROM
      (SELECT file, line, {NORMAL.format(c="trim(regexp_replace(text, '^\\s*(#|//)+', ''))")} AS a, {NORMAL.format(c='next_code')} AS b FROM nx WHERE c)
    WHERE a <> '' AND b <> '' AND 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) > 0.7""",
    ALL_RULES,
)(lambda t: D.trivial_comments(t.wide("code_lines")))
query(
    "commented_out_code",
    f"""SELECT file, MIN(line) AS line, COUNT(*) AS lines, COUNT(*) FILTER (WHERE {m('[;{}=]|' + chr(92) + 'w' + chr(92) + '(')}) AS code_lines FROM
      (SELECT *, SUM(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS g FROM cl) WHERE c GROUP BY file, g
    HAVING COUNT(*) >= 3 AND COUNT(*) FILTER (WHERE {m('[;{}=]|' + chr(92) + 'w' + chr(92) + '(')}) >= COUNT(*) * 0.5""",
    "cl AS (SELECT file, line, text, starts_with(trim(text), '#') AS c FROM (SELECT file, line, CASE WHEN line % 9 < 4 THEN '# ' || text || CASE WHEN line % 2 = 0 THEN ';' ELSE '' END ELSE text END AS text FROM (SELECT 'f' || CAST(user_id AS VARCHAR) AS file, event_id AS line, 'x' || CAST(k AS VARCHAR) AS text FROM event_k)))",
)(
    lambda t: D.commented_code(
        t("event_k").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("x")).select(
            "file", "line", F.lit("python").alias("lang"),
            F.when(F.col("line") % 9 < 4, F.concat(F.lit("# "), "x", F.when(F.col("line") % 2 == 0, ";").otherwise(""))).otherwise(F.col("x")).alias("text"),
        )
    )
)
FUNCS = """
fn AS (SELECT file, 'outer' AS func, 1 AS start_line, n AS end_line FROM (SELECT file, MAX(line) AS n FROM dl GROUP BY file)
  UNION ALL SELECT file, 'inner', 2, least(n, 6) FROM (SELECT file, MAX(line) AS n FROM dl GROUP BY file) WHERE n >= 3),
own AS (SELECT f.file, f.func, f.start_line, l.line, l.text FROM fn f JOIN dl l ON l.file = f.file AND l.line BETWEEN f.start_line AND f.end_line
  WHERE NOT (f.func = 'outer' AND EXISTS (SELECT 1 FROM fn i WHERE i.file = f.file AND i.func = 'inner' AND l.line BETWEEN i.start_line AND i.end_line)))
"""


def doc_lines(t):
    return S.numbered_lines(t.wide("documents").select(F.col("doc_id").cast("string").alias("file"), "text"), "file")


def doc_functions(t):
    """Functions of every document, written once: the text is read a single time however often they are used."""
    text = F.col("text")
    breaks = F.length("text") - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    n = (breaks + 1 - F.endswith(text, F.lit("\n")).cast("int")).cast("bigint")  # as many as X.lines has
    docs = t.wide("documents").select(F.col("doc_id").cast("string").alias("file"), n.alias("n"))
    part = lambda func, start, end: F.struct(F.lit(func).alias("func"), F.lit(start).cast("bigint").alias("start_line"), end.alias("end_line"))
    outer, inner = part("outer", 1, F.col("n")), part("inner", 2, F.least(F.col("n"), F.lit(6).cast("bigint")))
    found = docs.select("file", F.inline(F.when(F.col("n") >= 3, F.array(outer, inner)).otherwise(F.array(outer))))
    return Scratch(t.spark, "functions").save(found, "functions")


query(
    "comment_density",
    """SELECT file, func, start_line::BIGINT AS line, ROUND(c / (n - c), 6) AS ratio, ROUND(0.5 + least(c / (n - c), 1.0) * 0.5, 6)::DOUBLE AS confidence FROM
      (SELECT o.file, o.func, o.start_line, COUNT(*) AS n, COUNT(*) FILTER (WHERE contains(o.text, ',')) AS c, MAX(f.end_line - f.start_line + 1) AS len
       FROM own o JOIN fn f ON f.file = o.file AND f.func = o.func GROUP BY o.file, o.func, o.start_line) WHERE len >= 3 AND n - c > 0 AND c / (n - c) > 0.5""",
    DOC_LINES + "," + FUNCS,
)(lambda t: D.comment_density(doc_lines(t), doc_functions(t), F.contains("text", F.lit(","))))
query("innermost_functions", "SELECT file, line, func FROM own", DOC_LINES + "," + FUNCS)(lambda t: D.innermost(doc_functions(t)).select("file", "line", "func"))
IMPORTS = """
im AS (SELECT l_orderkey AS file, CASE l_linenumber % 3 WHEN 0 THEN 'os.path' || CAST(l_partkey % 5 AS VARCHAR) WHEN 1 THEN ' mod' || CAST(l_partkey % 5 AS VARCHAR) ELSE '' END AS specifier, CASE WHEN l_suppkey % 9 = 0 THEN 'use' ELSE 'import' END AS kind FROM lineitem),
us AS (SELECT l_orderkey AS file, CASE l_returnflag WHEN 'N' THEN 'path' ELSE 'mod' END || CAST(l_suppkey % 5 AS VARCHAR) AS name FROM lineitem)
"""


def import_inputs(t):
    l = t("lineitem")  # noqa: E741
    k, p = F.col("l_linenumber") % 3, (F.col("l_partkey") % 5).cast("string")
    im = l.select(
        F.col("l_orderkey").alias("file"), F.when(k == 0, F.concat(F.lit("os.path"), p)).when(k == 1, F.concat(F.lit(" mod"), p)).otherwise("").alias("specifier"),
        F.when(F.col("l_suppkey") % 9 == 0, "use").otherwise("import").alias("kind"),
    )
    us = l.select(F.col("l_orderkey").alias("file"), F.concat(F.when(F.col("l_returnflag") == "N", "path").otherwise("mod"), (F.col("l_suppkey") % 5).cast("string")).alias("name"))
    return im, us


query(
    "unused_imports",
    """SELECT file, trim(specifier) AS specifier FROM im WHERE kind = 'import' AND trim(specifier) <> '' AND NOT EXISTS (SELECT 1 FROM us WHERE us.file = im.file AND us.name IN (trim(specifier), split_part(trim(specifier), '.', -1)))""",
    IMPORTS,
)(lambda t: D.unused_imports(*import_inputs(t)))
TYPES = """
an AS (SELECT l_orderkey AS file, 'fn' || CAST(l_linenumber % 3 AS VARCHAR) AS func, 'p' AS param, CASE l_partkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'number[]' WHEN 2 THEN 'Option<u8>' WHEN 3 THEN '&str' ELSE 'map()' END AS type_expr,
  CASE l_orderkey % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'rust' ELSE 'elixir' END AS lang FROM lineitem),
gu AS (SELECT l_orderkey AS file, 'fn' || CAST(l_linenumber % 3 AS VARCHAR) AS func, 'p' AS param, CASE l_suppkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'Array' WHEN 2 THEN 'Some' WHEN 3 THEN 'str' ELSE 'map()' END AS guarded_type, l_linenumber AS line FROM lineitem)
"""


def type_inputs(t):
    pick = lambda c, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs) + 1).cast("int"))
    fn = F.concat(F.lit("fn"), (F.col("l_linenumber") % 3).cast("string")).alias("func")
    an = t("lineitem").select(
        F.col("l_orderkey").alias("file"), fn, F.lit("p").alias("param"), pick("l_partkey", "string", "number[]", "Option<u8>", "&str", "map()").alias("type_expr"), pick("l_orderkey", "typescript", "rust", "elixir").alias("lang")
    )
    gu = t("lineitem").select(F.col("l_orderkey").alias("file"), fn, F.lit("p").alias("param"), pick("l_suppkey", "string", "Array", "Some", "str", "map()").alias("guarded_type"), F.col("l_linenumber").alias("line"))
    return an, gu


query(
    "redundant_type_checks",
    """SELECT an.file, line, an.func, an.param, 'redundant_type_check' AS rule, CASE WHEN lang = 'elixir' THEN 'warning' ELSE 'critical' END AS severity, CASE WHEN lang = 'elixir' THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence
    FROM an JOIN gu ON an.file = gu.file AND an.func = gu.func AND an.param = gu.param WHERE type_expr = guarded_type OR (lang = 'typescript' AND guarded_type = 'Array' AND type_expr = 'number[]')
      OR (lang = 'rust' AND guarded_type = 'Some' AND starts_with(type_expr, 'Option')) OR (lang = 'rust' AND type_expr = '&str' AND guarded_type = 'str')""",
    TYPES,
)(lambda t: D.redundant_type_checks(*type_inputs(t)))
query(
    "unnecessary_defaults",
    """SELECT DISTINCT l_orderkey AS file, l_linenumber AS line, 'f' || CAST(l_partkey % 4 AS VARCHAR) AS name FROM lineitem
    WHERE l_suppkey % 3 <> 2 AND l_quantity >= 2 AND (l_orderkey + l_partkey % 4) % 2 = 0""",
)(
    lambda t: D.unnecessary_defaults(
        t("lineitem").select(
            F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"),
            F.element_at(F.array(F.lit("cfg.get"), F.lit("get"), F.lit("fetch")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("callee"),
            F.when(F.col("l_quantity") >= 2, F.array(F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")), F.lit("1"))).otherwise(F.array(F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")))).alias("args"),
        ),
        t("orders").select(F.col("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("file", F.concat(F.lit("f"), F.col("i").cast("string")).alias("name"), ((F.col("file") + F.col("i")) % 2 == 0).alias("required")),
    )
)


def linter_outputs(t):
    """Raw outputs of two external tools, one text per order."""
    o = t("orders")
    a = o.select(F.to_json(F.array(F.struct(F.when(F.col("o_orderkey") % 4 != 0, F.lit("E501")).alias("code"), F.lit("long").alias("message"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("filename"), (F.col("o_orderkey") % 90).alias("row")))).alias("value"))
    b = o.select(
        F.to_json(
            F.struct(
                F.array(
                    F.struct(F.lit("Design").alias("category"), F.lit("todo").alias("message"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("filename"), (F.col("o_orderkey") % 7).alias("line_no"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 30).alias("priority"))
                ).alias("issues")
            )
        ).alias("value")
    )
    return a, b


def external(t):
    return D.merge_findings(J.parse_list_linter(linter_outputs(t)[0], "ruff"), J.parse_issue_linter(linter_outputs(t)[1], "credo"))


EXTERNAL = """SELECT 'lint' AS category, 'E501' AS rule, 'warning' AS severity, 'long' AS message, 'f' || CAST(o_custkey AS VARCHAR) AS file, o_orderkey % 90 AS line, 'ruff' AS source, 1.0::DOUBLE AS confidence FROM orders WHERE o_orderkey % 4 <> 0
    UNION ALL SELECT 'Design', 'credo_design', CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 30 >= 20 THEN 'critical' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 30 >= 10 THEN 'warning' ELSE 'info' END, 'todo', 'f' || CAST(o_custkey AS VARCHAR), o_orderkey % 7, 'credo', 1.0 FROM orders"""
query(
    "external_findings",
    EXTERNAL,
)(external)


def shown(counts):
    """Counts by name as one text."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(counts)), lambda k: F.concat(k, F.lit("="), counts[k].cast("string"))), ",")


def merged_reports(t):
    files = t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"))
    own = t("customer").where("c_custkey % 6 = 0").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"), F.lit("info").alias("severity"), F.lit("Design").alias("category"))
    merged = D.merge_reports(D.reports(files, own), external(t))
    return merged.select("file", "total", shown(F.col("by_severity")).alias("severities"), shown(F.col("by_category")).alias("categories"))


query(
    "merged_reports",
    """SELECT file, CAST(COALESCE(n, 0) AS BIGINT) AS total, COALESCE(s, '') AS severities, COALESCE(c, '') AS categories FROM names
      LEFT JOIN (SELECT file, SUM(n) AS n, string_agg(severity || '=' || CAST(n AS VARCHAR), ',' ORDER BY severity) AS s FROM (SELECT file, severity, COUNT(*) AS n FROM every GROUP BY ALL) GROUP BY file) USING (file)
      LEFT JOIN (SELECT file, string_agg(category || '=' || CAST(n AS VARCHAR), ',' ORDER BY category) AS c FROM (SELECT file, category, COUNT(*) AS n FROM every GROUP BY ALL) GROUP BY file) USING (file)""",
    f"""ext AS ({EXTERNAL}),
    every AS (SELECT file, severity, category FROM ext UNION ALL SELECT 'f' || CAST(c_custkey AS VARCHAR), 'info', 'Design' FROM customer WHERE c_custkey % 6 = 0),
    names AS (SELECT 'f' || CAST(c_custkey AS VARCHAR) AS file FROM customer WHERE c_custkey % 2 = 0 UNION SELECT file FROM ext)""",
)(merged_reports)

# -- clones ------------------------------------------------------------------------------
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\"[^\"\\n]*\"|''[^''\\n]*''', chr(1), 'g'), '[\\p{L}_][\\p{L}\\p{N}_]*', chr(2), 'g'), '[0-9]+(\\.[0-9]+)?', chr(3), 'g'), '\\s+', ' ', 'g'))"
PRINTS = f"""
un AS (SELECT *, replace(replace(replace({NORM}, chr(1), '$STR'), chr(2), '$VAR'), chr(3), '$NUM') AS n FROM {{src}}),
pr AS (SELECT file, line, sha256(n) AS hash, sha256(regexp_replace(n, '(\\$(VAR|STR|NUM) ?)+', '$ ', 'g')) AS skeleton_hash FROM un WHERE length(n) >= 1)
"""


def code_prints(t):
    return K.fingerprints(t.wide("code_lines").select("file", "line", "text"))


query("code_clones", "SELECT file, line, hash, COUNT(*) OVER (PARTITION BY hash) AS members FROM pr QUALIFY members >= 2", PRINTS.replace('{src}', 'code_lines'))(lambda t: K.structural(code_prints(t)))
query(
    "skeleton_clones",
    "SELECT file, line, skeleton_hash, COUNT(*) OVER w AS members FROM pr WINDOW w AS (PARTITION BY skeleton_hash) QUALIFY members >= 2 AND MIN(hash) OVER w <> MAX(hash) OVER w",
    PRINTS.replace('{src}', 'code_lines'),
)(lambda t: K.boilerplate(code_prints(t)))
query("document_clones", "SELECT file, hash, COUNT(*) OVER (PARTITION BY hash) AS members FROM pr QUALIFY members >= 2", "d0 AS (SELECT doc_id AS file, 0 AS line, text FROM documents)," + PRINTS.replace('{src}', 'd0'))(
    lambda t: K.structural(K.fingerprints(t.wide("documents").select(F.col("doc_id").alias("file"), "text")))
)
query("line_clones", "SELECT file, line, hash, COUNT(*) OVER (PARTITION BY hash) AS members FROM pr QUALIFY members >= 2", DOC_LINES + "," + PRINTS.replace('{src}', 'dl'))(
    lambda t: K.structural(K.fingerprints(doc_lines(t)))
)

# -- segmentation and lint ------------------------------------------------------------------
LINES_OF = "{n} AS (SELECT doc, i::BIGINT AS line, ls[i] AS text FROM (SELECT doc, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM {src}), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))"
query("numbered_lines", "SELECT doc_id, line, text FROM nl", LINES_OF.format(n="nl0", src="(SELECT doc_id AS doc, text FROM documents)") + ", nl AS (SELECT doc AS doc_id, line, text FROM nl0)")(
    lambda t: S.numbered_lines(t("documents").select("doc_id", "text"), "doc_id")
)
FENCE = LINES_OF.format(n="ml", src="md_docs") + r""",
mk AS (SELECT *, CASE WHEN regexp_matches(rtrim(text), '(?i)^\s*```(bdd|dsl|bdd-dsl)\s*$') THEN 'open' WHEN regexp_matches(rtrim(text), '^\s*```\s*$') THEN 'close' END AS k FROM ml),
ms AS (SELECT *, COALESCE(LAST_VALUE(k IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'open' AS inside FROM mk),
mb AS (SELECT *, SUM(CASE WHEN k = 'open' AND NOT inside THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING) AS block FROM ms)
"""
query(
    "fenced_blocks",
    """SELECT doc, block::BIGINT AS block, MIN(line) FILTER (WHERE k = 'open' AND NOT inside) + 1 AS start_line,
      COALESCE(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE inside AND COALESCE(k, '') <> 'close'), '') AS content, bool_or(inside AND COALESCE(k, '') = 'close') AS closed
    FROM mb WHERE inside OR k = 'open' GROUP BY doc, block""",
    FENCE,
)(lambda t: S.fenced_blocks(t.wide("md_docs")))
SCEN = LINES_OF.format(n="sl", src="dsl_docs") + r""",
sf AS (SELECT doc, line, trim(text) AS text, starts_with(trim(text), '[SCENARIO:') AS h FROM sl WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')),
sg AS (SELECT *, (SUM(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM sf),
sc AS (SELECT doc, segment, line, trim(regexp_extract(text, '^\[SCENARIO:\s*([^\]]+)\]', 1)) AS id, regexp_extract(text, '^\[SCENARIO:\s*[^\]]+\]\s*(.*)$', 1) AS rest FROM sg WHERE h),
scn AS (SELECT doc, segment, line, id, trim(regexp_replace(regexp_extract(rest, 'TITLE:\s*(.*)$', 1), '\s*TAGS:.*$', '')) AS title, list_filter(string_split(trim(regexp_extract(rest, 'TAGS:\s*(.*)$', 1)), ' '), lambda x: x <> '') AS tags FROM sc),
stp AS (SELECT doc, segment, line, lower(regexp_extract(text, '^(GIVEN|WHEN|THEN)\s+(\S+)', 1)) AS kind, regexp_extract(text, '^(GIVEN|WHEN|THEN)\s+(\S+)', 2) AS name, text AS raw FROM sg WHERE NOT h AND segment > 0)
"""
query("scenarios", "SELECT doc, segment, line, id, title, array_to_string(tags, ' ') AS tags FROM scn", SCEN)(
    lambda t: S.scenarios(t.wide("dsl_docs")).withColumn("tags", F.array_join("tags", " "))
)
query("scenario_steps", "SELECT doc, segment, line, kind, name, regexp_extract(raw, 'product_id=\"([^\"]*)\"', 1) AS product_id FROM stp", SCEN)(
    lambda t: S.steps(t.wide("dsl_docs")).select("doc", "segment", "line", "kind", "name", F.coalesce(F.col("args")["product_id"], F.lit("")).alias("product_id"))
)
query("stray_steps", "SELECT doc, line, 'step_before_header' AS error, text FROM sg WHERE segment = 0", SCEN)(lambda t: S.stray_steps(t.wide("dsl_docs")))
LINT = SCEN + r""",
kn AS (SELECT s.*, i.assert_class, COALESCE(i.is_async, FALSE) AS asy, COALESCE(i.is_eventually, FALSE) AS evt, i.boundary FROM stp s LEFT JOIN instructions i ON i.name = s.name),
fa AS (SELECT doc, segment, COUNT(*) FILTER (WHERE kind = 'then') AS th, COUNT(*) FILTER (WHERE kind = 'then' AND (assert_class IS NULL OR assert_class = 'weak')) AS wk,
  COUNT(*) FILTER (WHERE kind = 'then' AND assert_class IN ('A', 'B', 'C', 'D', 'error')) AS st, COUNT(*) FILTER (WHERE kind = 'when' AND asy) AS ac, COUNT(*) FILTER (WHERE kind = 'then' AND evt) AS ev,
  COUNT(*) FILTER (WHERE kind = 'then' AND name = 'assert_http_snapshot') AS sn, COUNT(*) FILTER (WHERE kind = 'then' AND name = 'then_seed_contract_should_hold') AS sd,
  COUNT(*) FILTER (WHERE kind = 'then' AND assert_class = 'D' AND boundary = 'external_io') AS io, COUNT(*) FILTER (WHERE kind = 'then' AND regexp_matches(raw, '(?i)\b(mock|spy|stub|called|invoked)\b')) AS ia FROM kn GROUP BY doc, segment),
li AS (SELECT s.*, COALESCE(th, 0) AS th, COALESCE(wk, 0) AS wk, COALESCE(st, 0) AS st, COALESCE(ac, 0) AS ac, COALESCE(ev, 0) AS ev, COALESCE(sn, 0) AS sn, COALESCE(sd, 0) AS sd, COALESCE(io, 0) AS io, COALESCE(ia, 0) AS ia,
  COALESCE(c1.edge_class, c2.edge_class) AS ec, COALESCE(c1.action_steps, c2.action_steps) AS aps, COALESCE(c1.branch_hints, c2.branch_hints) AS bh, COALESCE(c1.facts, c2.facts) AS fc
  FROM scn s LEFT JOIN fa ON fa.doc = s.doc AND fa.segment = s.segment LEFT JOIN seed_contracts c1 ON c1.contract_id = s.id LEFT JOIN seed_contracts c2 ON c2.contract_id = NULLIF(regexp_extract(s.id, '-SEED-(.*)$', 1), ''))
"""

DSL_ROWS = 200_000  # documents of one task: some hundred bytes of text stand behind a row of orders


def lint(t):
    return V.lint_rows(S.scenario_rows(t.wide("dsl_docs", DSL_ROWS)), t("instructions"), t("seed_contracts"))


query(
    "scenario_lint",
    """SELECT doc, segment, id, 'missing_then' AS rule FROM li WHERE th = 0
    UNION ALL SELECT doc, segment, id, 'weak_assertion' FROM li WHERE th > 0 AND wk = th AND NOT (sd > 0 AND ec IS NOT NULL AND
      CASE WHEN ec = 'workflow_contract' THEN aps >= 2 OR bh > 0 OR (aps = 1 AND bh = 0) ELSE fc > 0 OR aps > 0 OR bh > 0 END)
    UNION ALL SELECT doc, segment, id, 'insufficient_evidence' FROM li WHERE list_contains(tags, 'strict_evidence') AND st = 0
    UNION ALL SELECT doc, segment, id, 'async_without_eventually' FROM li WHERE ac > 0 AND ev = 0
    UNION ALL SELECT doc, segment, id, 'pure_snapshot' FROM li WHERE list_contains(tags, 'strict_snapshot') AND sn > 0 AND sn = th
    UNION ALL SELECT doc, segment, id, 'over_interaction_assertion' FROM li WHERE list_contains(tags, 'strict_interaction') AND NOT list_contains(tags, 'e2e') AND NOT list_contains(tags, 'allow_interaction_assert') AND io = 0 AND ia > 0
    UNION ALL SELECT doc, segment, id, CASE ec WHEN 'determination_contract' THEN 'determination_degraded_pass' ELSE 'reactor_degraded_pass' END FROM li WHERE sd > 0 AND ec IN ('determination_contract', 'reactor_contract')""",
    LINT,
)(lambda t: lint(t).drop("tags"))
query("scenario_contracts", "SELECT doc, segment, id, ec AS edge_class FROM li WHERE ec IS NOT NULL", LINT)(
    lambda t: V.match_contracts(S.scenarios(t.wide("dsl_docs")), t("seed_contracts")).filter("contract IS NOT NULL").select("doc", "segment", "id", F.col("contract.edge_class").alias("edge_class"))
)
query(
    "step_lint",
    r"""SELECT doc, line, 'sleep_anti_pattern' AS rule FROM stp WHERE contains(lower(raw), 'sleep')
    UNION ALL SELECT doc, line, 'order_dependence' FROM stp WHERE regexp_matches(raw, '(?i)(^|\s)index=') OR regexp_matches(raw, '(?i)(^|\s)first\b') OR regexp_matches(raw, '(?i)(^|\s)last\b')
    UNION ALL SELECT doc, line, 'impl_detail_reference' FROM stp WHERE regexp_matches(raw, '\b(Repo|Ecto|Schema|Changeset)\b|\bfrom\(') OR regexp_matches(raw, '(?i)\b(insert_all|update_all|transaction|rollback|SQL)\b')
    UNION ALL SELECT s.doc, s.line, 'unique_risk' FROM stp s JOIN scn c ON c.doc = s.doc AND c.segment = s.segment WHERE list_contains(c.tags, 'strict_unique') AND s.kind = 'given' AND s.name = 'create_product' AND contains(raw, 'product_id=')""",
    SCEN,
)(lambda t: V.step_lint_rows(S.scenario_rows(t.wide("dsl_docs", DSL_ROWS))))
query(
    "duplicate_scenarios",
    """SELECT s.id, s.doc, s.line, f.doc AS first_doc, f.line AS first_line FROM scn s JOIN (SELECT id, MIN({'doc': doc, 'line': line}) AS r, COUNT(*) AS n FROM scn GROUP BY id) g ON g.id = s.id AND g.n > 1
    JOIN scn f ON f.id = s.id AND f.doc = g.r.doc AND f.line = g.r.line WHERE s.doc <> f.doc OR s.line <> f.line""",
    SCEN,
)(lambda t: V.duplicate_ids(S.scenarios(t.wide("dsl_docs"))))
query(
    "uncovered_instructions",
    """SELECT name, r.doc AS doc, r.line AS line FROM (SELECT name, MIN({'doc': doc, 'line': line}) AS r FROM stp WHERE name NOT IN (SELECT name FROM instructions) GROUP BY name)""",
    SCEN,
)(lambda t: V.uncovered_instructions(S.steps(t.wide("dsl_docs")), t("instructions")))
query(
    "negative_coverage",
    """SELECT o_custkey AS suite, COUNT(*) AS scenarios, 0::BIGINT AS negatives FROM (SELECT o.o_custkey, s.doc, s.segment, EXISTS (SELECT 1 FROM stp p WHERE p.doc = s.doc AND p.segment = s.segment AND ((p.kind = 'then' AND p.name = 'assert_last_error') OR (p.kind = 'when' AND starts_with(p.name, 'try_')))) AS neg
      FROM scn s JOIN orders o ON o.o_orderkey = s.doc WHERE list_contains(s.tags, 'integration') OR list_contains(s.tags, 'e2e')) GROUP BY o_custkey HAVING COUNT(*) FILTER (WHERE neg) = 0""",
    SCEN,
)(
    lambda t: V.negative_blocks(S.scenario_blocks(t.wide("dsl_docs", DSL_ROWS)), t("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("suite")), "suite")
)


def warnings(t):
    return lint(t).withColumn("file", F.concat(F.lit("bdd/"), F.col("doc").cast("string"), F.lit(".dsl")))


LINT_N = "(SELECT COUNT(*) FROM li WHERE th = 0)"
query(
    "warning_gate",
    """SELECT COUNT(*) AS warnings, COALESCE(bool_or(list_contains(tags, 'e2e')), FALSE) AS fails_by_tag, FALSE AS fails_by_file, COUNT(*) > 0 AS fails_by_default FROM li WHERE th = 0""",
    LINT,
)(
    lambda t: V.warning_gates(
        warnings(t).filter("rule = 'missing_then'"), {"fails_by_tag": (["e2e"], None), "fails_by_file": (None, ["other/**"]), "fails_by_default": (None, None)}
    )
)
QUAL = r"""
qr AS (SELECT doc, array_to_string(list_filter([CASE WHEN NOT contains(text, '[SCENARIO:') THEN 'missing [SCENARIO:] header' END, CASE WHEN NOT regexp_matches(text, '(?m)^GIVEN ') THEN 'missing GIVEN step' END,
  CASE WHEN NOT regexp_matches(text, '(?m)^WHEN ') THEN 'missing WHEN step' END, CASE WHEN NOT regexp_matches(text, '(?m)^THEN ') THEN 'missing THEN step' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM {src})
"""
query("scenario_quality", "SELECT doc, reasons FROM qr WHERE reasons <> ''", QUAL.format(src="(SELECT doc, content AS text FROM (SELECT doc, replace(text, 'GIVEN create', 'given create') AS content FROM dsl_docs UNION ALL SELECT doc + 100000000, text FROM md_docs))"))(
    lambda t: V.quality_reasons(
        t.wide("dsl_docs").select("doc", F.replace("text", F.lit("GIVEN create"), F.lit("given create")).alias("text")).union(t.wide("md_docs").select(F.col("doc") + 100000000, "text"))
    )
)
query("scenario_quality_report", "SELECT COUNT(*) AS total_files, COUNT(*) FILTER (WHERE reasons <> '') AS invalid_files FROM qr", QUAL.format(src="md_docs"))(lambda t: V.quality_report(t.wide("md_docs")))
query(
    "scenarios_per_module",
    """SELECT o_orderpriority AS module, COUNT(*) AS files, SUM(len(regexp_extract_all(text, '\\[SCENARIO:')))::BIGINT AS scenarios FROM dsl_docs JOIN orders ON o_orderkey = doc GROUP BY ROLLUP (o_orderpriority)""",
)(lambda t: V.scenarios_per_module(t.wide("dsl_docs").join(t("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("module")), "doc")))
query(
    "section_gaps",
    r"""SELECT doc, s AS section, CASE WHEN p = 0 THEN 'missing' ELSE 'empty' END AS state FROM (SELECT doc, s, p, after, strpos(after, chr(10) || '## ') AS e FROM
      (SELECT doc, s, strpos(text, '## ' || s) AS p, substr(text, strpos(text, '## ' || s) + length('## ' || s)) AS after FROM section_docs, (SELECT unnest(['Role', 'Limits', 'Flow', 'Errors']) AS s)))
    WHERE p = 0 OR regexp_replace(CASE WHEN e > 0 THEN substr(after, 1, e - 1) ELSE after END, '\s+', '', 'g') = ''""",
)(lambda t: V.section_gaps(t("section_docs"), ("Role", "Limits", "Flow", "Errors")))
query("document_coverage", "SELECT COUNT(*) AS total_files, COUNT(l.doc_id) AS with_docs, COUNT(*) - COUNT(l.doc_id) AS missing_docs FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")(
    lambda t: V.document_coverage(t("documents"), t("labels"), "doc_id")
)
query("missing_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: V.missing_documents(t("documents"), t("labels"), "doc_id"))

# -- files in the library's own formats, written and read again --------------------------
PART_SCHEMA = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_brand", T.StringType()), T.StructField("p_size", T.IntegerType())])


def tsv_parts(t):
    folder = Scratch(t.spark, "tsv").root
    rows = t("part").select("p_partkey", "p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("p_brand"), "p_size")
    J.write_tsv(rows, folder)
    return J.read_tsv(t.spark, folder, PART_SCHEMA)


query("tsv_round_trip", "SELECT p_partkey, p_name, CASE WHEN p_size % 3 <> 0 THEN p_brand ELSE '' END AS p_brand, p_size FROM part")(tsv_parts)


def snapshot_files(t):
    folder = f"{Scratch(t.spark, 'snapshots').root}/files"
    snapshot_texts(t).write.text(folder)
    return J.references(J.parse_records(t.spark.read.text(folder)))


query(
    "snapshot_files",
    """SELECT 'orders/' || CAST(l_orderkey AS VARCHAR) AS src_path, 'parts/' || CAST(l_partkey AS VARCHAR) AS dst_path,
      CASE WHEN l_returnflag = 'N' THEN 'import' ELSE 'call' END AS kind FROM lineitem""",
)(snapshot_files)


def contract_files(t):
    """Contract documents (one JSON object per supplier) written, read and flattened to edges."""
    edge = F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("caller"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("callee"))
    docs = t("lineitem").groupBy("l_suppkey").agg(F.collect_set(edge).alias("allow_edges"))
    folder = Scratch(t.spark, "contracts").root
    J.write_report({"allow": docs.select("allow_edges")}, folder)
    read = t.spark.read.schema("allow_edges array<struct<caller: string, callee: string>>").json(f"{folder}/allow")
    return J.contract_edges(read, "allow_edges")


query("contract_files", "SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS caller, 'p' || CAST(l_partkey % 50 AS VARCHAR) AS callee FROM lineitem")(contract_files)


def hints(t):
    """Relation hints of snapshot records, one per part."""
    hint = F.struct(
        F.concat(F.lit("lib\\"), "p_type").alias("target"), F.lit("call").alias("call_type_hint"), F.col("p_brand").alias("via"), (F.col("p_size") / 100).alias("confidence"),
        F.lit("text").alias("detector"), F.col("p_name").alias("reason"),
    )
    record = F.struct(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("sourcePath"), F.array(hint).alias("relationHints"))
    return J.hint_rows(J.parse_records(t("part").select(F.to_json(record).alias("value"))))


query(
    "snapshot_hints",
    """SELECT 'parts/' || CAST(p_partkey AS VARCHAR) AS src_path, 'lib/' || p_type AS dst_path, 'call' AS call_type_hint, p_brand AS via, CAST(p_size AS DOUBLE) / 100 AS confidence, 'text' AS detector, p_name AS reason FROM part""",
)(hints)
