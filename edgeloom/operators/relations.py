"""Path-to-module mapping and weighted module relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.session import Scratch

DEFAULT_PRECEDENCE = 1000
MIN_HINT_CONFIDENCE = 0.75


def _rule_hits(paths: DataFrame, rules: DataFrame, globs: str) -> DataFrame:
    """(path, module_id, precedence) for every rule glob that matches the path.

    The literal folder of a glob must be one of the path's folders, so the
    pattern test runs behind an equi join instead of a nested loop.
    """
    flat = rules.select("module_id", "precedence", F.explode(globs).alias("glob")).select(
        "module_id",
        "precedence",
        P.glob_folder(F.col("glob")).alias("folder"),
        P.glob_regex(F.col("glob")).alias("regex"),
    )
    keyed = paths.select("path", F.explode(P.folders(F.col("path"))).alias("folder"))
    return keyed.join(flat, "folder").filter(F.regexp_like("path", F.col("regex")))


def map_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, module) by include/exclude globs; lowest precedence, then module id, wins."""
    unique = paths.select(P.posix(F.col("path")).alias("path")).distinct()
    ranked = rules.withColumn("precedence", F.coalesce("precedence", F.lit(DEFAULT_PRECEDENCE)))
    hits = _rule_hits(unique, ranked, "include")
    excluded = _rule_hits(unique, ranked, "exclude").select("path", "module_id")
    kept = hits.join(excluded, ["path", "module_id"], "left_anti")
    return (
        kept.groupBy("path")
        .agg(F.min(F.struct("precedence", "module_id")).alias("best"))
        .select("path", F.col("best.module_id").alias("module"))
    )


def module_pairs(refs: DataFrame, path_module: DataFrame) -> DataFrame:
    """Resolved cross-module references (caller, callee, src_path, dst_path, imports, calls).

    References are summed per path pair first, so a hot file reaches the joins
    as one row per partner instead of one row per reference.
    """
    pairs = refs.groupBy("src_path", "dst_path").agg(
        F.count_if(F.col("kind") == "import").alias("imports"),
        F.count_if(F.col("kind") == "call").alias("calls"),
    )
    src = path_module.select(F.col("path").alias("src_path"), F.col("module").alias("caller"))
    dst = path_module.select(F.col("path").alias("dst_path"), F.col("module").alias("callee"))
    return pairs.join(src, "src_path").join(dst, "dst_path").filter("caller <> callee")


def relation_weights(refs: DataFrame, path_module: DataFrame) -> DataFrame:
    """(caller, callee, import_edges, call_edges, total_edges).

    References meet the module of their source once and are then counted by (caller, target path), where the map side
    already sums; only these counts meet the module of the target, so no pairs of paths are shuffled.
    """
    kinds = refs.select("src_path", "dst_path", (F.col("kind") == "import").alias("import"), (F.col("kind") == "call").alias("call"))
    src = path_module.select(F.col("path").alias("src_path"), F.col("module").alias("caller"))
    dst = path_module.select(F.col("path").alias("dst_path"), F.col("module").alias("callee"))
    counts = kinds.join(src, "src_path").groupBy("caller", "dst_path").agg(F.count_if("import").alias("imports"), F.count_if("call").alias("calls"))
    return (
        counts.join(dst, "dst_path")
        .filter("caller <> callee")
        .groupBy("caller", "callee")
        .agg(F.sum("imports").alias("import_edges"), F.sum("calls").alias("call_edges"))
        .withColumn("total_edges", F.col("import_edges") + F.col("call_edges"))
    )


def edge_severity(refs: DataFrame, path_module: DataFrame) -> DataFrame:
    """Call ratio, distinct files and the share of the heaviest file on each side."""
    pairs = module_pairs(refs, path_module).withColumn("n", F.col("imports") + F.col("calls"))
    # three groupings follow; the written pairs spare them the two joins
    pairs = Scratch(refs.sparkSession, "pairs").save(pairs, "pairs")
    edge = ["caller", "callee"]

    def side(path: str, label: str) -> DataFrame:
        per_file = pairs.groupBy(*edge, path).agg(F.sum("n").alias("n"))
        return per_file.groupBy(*edge).agg(
            F.count("*").alias(f"{label}_file_count"),
            F.max("n").alias(f"{label}_top_n"),
            F.min_by(path, F.struct(-F.col("n"), F.col(path))).alias(f"top_{label}"),
        )

    totals = pairs.groupBy(*edge).agg(F.sum("calls").alias("call_edges"), F.sum("n").alias("total_edges"))
    joined = totals.join(side("src_path", "src"), edge).join(side("dst_path", "dst"), edge)
    share = lambda top: F.round(F.col(top) * 100.0 / F.col("total_edges"), 2)
    return joined.select(
        *edge,
        "total_edges",
        F.round(F.col("call_edges") / F.col("total_edges"), 4).alias("call_ratio"),
        "src_file_count",
        "dst_file_count",
        share("src_top_n").alias("top_src_share_pct"),
        share("dst_top_n").alias("top_dst_share_pct"),
        "top_src",
        "top_dst",
    )


def _hint_type(raw: Column) -> Column:
    """Spellings of the hint kinds are fixed values."""
    token = F.lower(F.trim(raw))
    return (
        F.when(token.isin("framework_injection", "framework"), "framework_injection")
        .when(token.isin("external_registration", "external_lib", "registration"), "external_registration")
        .otherwise("direct_call")
    )


def classify_edges(relations: DataFrame, hints: DataFrame) -> DataFrame:
    """Best hint per edge: kind, then clamped confidence, then text lengths.

    hints: (caller, callee, call_type_hint, via, confidence, detector, reason).
    Non-direct hints below 0.75 leave the edge a direct call.
    """
    finite = F.when(F.isnan("confidence") | (F.abs("confidence") == float("inf")), 0.0).otherwise(F.col("confidence"))
    priority = (
        F.when(F.col("call_type") == "external_registration", 3)
        .when(F.col("call_type") == "framework_injection", 2)
        .otherwise(1)
    )
    clamped = hints.withColumn("call_type", _hint_type(F.col("call_type_hint"))).withColumn("confidence", F.least(F.greatest(finite, F.lit(0.0)), F.lit(1.0)))
    # Of hints that differ in confidence alone only the surest can win or tell why none does. A maximum of numbers is
    # hashed; the picks of structs with texts below sort their input, so they get the few rows that are left.
    surest = clamped.groupBy("caller", "callee", "call_type", "via", "detector", "reason").agg(F.max("confidence").alias("confidence"))
    scored = surest.withColumn("usable", (F.col("call_type") == "direct_call") | (F.col("confidence") >= MIN_HINT_CONFIDENCE)).withColumn(
        "rank",
        F.struct(
            priority.alias("p"),
            F.col("confidence").alias("c"),
            F.length("via").alias("v"),
            F.length("detector").alias("d"),
            F.col("via").alias("tv"),
            F.col("detector").alias("td"),
            F.col("reason").alias("tr"),
        ),
    )
    best = scored.groupBy("caller", "callee").agg(
        F.max_by(
            F.struct("call_type", "via", "confidence", "detector", "reason"), F.when(F.col("usable"), F.col("rank"))
        ).alias("hit"),
        F.max(F.when(F.col("call_type") != "direct_call", F.col("rank")))["c"].alias("weak"),
    )
    used = F.col("hit").isNotNull()
    fallback = F.when(
        F.col("weak").isNotNull(), F.format_string("hint confidence %.2f below threshold 0.75", F.col("weak"))
    ).otherwise("no relation hint")
    return (
        relations.select("caller", "callee")
        .join(best, ["caller", "callee"], "left")
        .select(
            "caller",
            "callee",
            F.when(used, F.col("hit.call_type")).otherwise("direct_call").alias("call_type"),
            F.when(used, F.col("hit.via")).otherwise("").alias("via"),
            F.when(used, F.col("hit.confidence")).otherwise(1.0).alias("confidence"),
            F.when(used, "ast_hint").otherwise("fallback").alias("source"),
            F.when(used, F.col("hit.detector")).otherwise("").alias("detector"),
            F.when(used, F.col("hit.reason")).otherwise(fallback).alias("reason"),
        )
    )


def resolve_candidates(refs: DataFrame, known: DataFrame, spellings: list[Column]) -> DataFrame:
    """First spelling of ``target`` that exists in ``known(path)``; unresolved rows drop.

    Adds ``resolved`` to refs(source, target).
    """
    targets = refs.select("target").distinct()
    tried = targets.select("target", F.posexplode(F.array(*spellings)).alias("pos", "path"))
    found = (
        tried.join(known.select("path").distinct(), "path")
        .groupBy("target")
        .agg(F.min(F.struct("pos", "path"))["path"].alias("resolved"))
    )
    return refs.join(found, "target")


def module_spellings(target: Column) -> list[Column]:
    """Spellings tried for a module dependency, in order."""
    return [
        target,
        F.concat(F.lit("./"), target),
        F.regexp_replace(target, r"^(\./)+", ""),
        F.concat(F.lit("src/"), target),
        F.regexp_replace(target, r"^(src/)+", ""),
    ]


def call_spellings(target: Column) -> list[Column]:
    """Spellings tried for a call target, in order."""
    tail = F.lit("#file#1")
    return [
        F.concat(target, tail),
        F.concat(F.regexp_replace(target, r"^(\./src/)+", ""), tail),
        F.concat(F.regexp_replace(target, r"^(src/)+", ""), tail),
        target,
    ]


def resolve_package_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(specifier, resolved): exact package name, else its longest ``/`` prefix."""
    parts = F.split("specifier", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("p"))
    )
    tried = imports.select("specifier").distinct().select("specifier", F.explode(prefixes).alias("x"))
    return (
        tried.select("specifier", F.col("x.n").alias("n"), F.col("x.p").alias("package"))
        .join(packages, "package")
        .groupBy("specifier")
        .agg(F.max_by("target", "n").alias("resolved"))
    )


def expand_aliases(specifier: Column) -> Column:
    """Module names of ``A.{B, C}`` and ``A.B, as: X`` forms."""
    spec = F.trim(specifier)
    bare = lambda c: F.trim(F.split(c, ",")[0])
    prefix = F.regexp_replace(F.trim(F.regexp_extract(spec, r"^([^{]*)\{", 1)), r"\.+$", "")
    inner = F.regexp_extract(spec, r"\{([^}]*)\}", 1)
    names = F.transform(F.split(inner, ","), lambda x: F.concat(prefix, F.lit("."), F.trim(x)))
    many = F.filter(names, lambda x: ~x.endswith("."))
    one = F.filter(F.array(bare(spec)), lambda x: x != "")
    return F.when(spec.rlike(r"\{[^}]*\}"), many).otherwise(one)


def resolve_names(names: DataFrame, modules: DataFrame) -> DataFrame:
    """(source, name, path): full-name match first, short-name match as fallback; of several files the least path."""
    full = modules.groupBy("name").agg(F.min("path").alias("full_path"))
    short = (
        modules.select(F.element_at(F.split("name", r"\."), -1).alias("short"), F.col("path"))
        .groupBy("short")
        .agg(F.min("path").alias("short_path"))
    )
    return (
        names.dropDuplicates(["source", "name"])
        .withColumn("short", F.element_at(F.split("name", r"\."), -1))
        .join(full, "name", "left")
        .join(short, "short", "left")
        .select("source", "name", F.coalesce("full_path", "short_path").alias("path"))
        .filter("path IS NOT NULL")
    )


def module_refs(text: Column) -> Column:
    """Dotted names whose leading segments (two or more) start upper-case, first use first."""
    raw = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9_.]*)"), 1)

    def head(name: Column) -> Column:
        parts = F.split(name, r"\.")
        lower = F.array_position(F.transform(parts, lambda p: p.rlike("^[A-Z]")), F.lit(False))
        n = F.when(lower > 0, lower - 1).otherwise(F.size(parts)).cast("int")
        return F.when(n >= 2, F.array_join(F.slice(parts, 1, n), "."))

    return F.array_distinct(F.array_compact(F.transform(F.array_distinct(raw), head)))


def referenced_modules(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, ref, module): dotted names in texts(key, text) that names(name, module) knows, or whose longest known head it is.

    Each reference is looked up with all its heads of two segments or more by one equi join; the longest one that is known
    counts. Of repeated names the least module counts.
    """
    refs = texts.select(key, F.explode(module_refs(F.col("text"))).alias("ref")).distinct()
    parts = F.split("ref", r"\.")
    heads = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("name")))
    known = names.groupBy("name").agg(F.min("module").alias("module"))
    found = refs.select(key, "ref", F.explode(heads).alias("h")).select(key, "ref", "h.*").join(known, "name")
    return found.groupBy(key, "ref").agg(F.max_by("module", "n").alias("module"))


def export_module_map(entries: DataFrame, grain: str = "file") -> DataFrame:
    """(key, module): first entry per file or per folder wins; entries(pos, path, module_id)."""
    if grain not in ("file", "dir"):
        raise ValueError("grain is file or dir")
    path = P.posix(F.col("path"))
    key = path if grain == "file" else P.directory(path)
    return entries.groupBy(key.alias("key")).agg(F.min_by("module_id", F.struct("pos", "path")).alias("module"))
