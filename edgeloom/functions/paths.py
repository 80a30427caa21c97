"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name suffixes removed before a module name is derived.
MODULE_SUFFIXES = (
    "Controller", "Service", "Trait", "Model", "Handler", "Command", "Query", "Helper", "Test", "Spec", "Factory",
    "_controller", "_service", "_test", "_handler", "_model",
)
# Names too general to be a module.
GENERIC_NAMES = ("", "base", "index", "app", "main")
# Directories skipped when looking for a module name.
GENERIC_DIRS = (
    "lib", "app", "src", "controllers", "models", "services", "traits", "handlers", "commands", "queries", "helpers",
    "test", "tests", "spec", "shop", "web",
)
# File kinds in match order.
FILE_KINDS = ("controller", "model", "trait", "service")
# Paths that need a second look.
HIGH_RISK_PREFIXES = ("auth/", "infra/", "deploy/", ".github/")
HIGH_RISK_FILES = ("Dockerfile", "docker-compose.yml", "Makefile", ".env", ".env.example")
# Markers of test paths.
TEST_PARTS = ("/test/", "/tests/", "/spec/", "_test.", ".test.", "_spec.", ".spec.")
TEST_PREFIXES = ("test/", "tests/")
# Keyword heuristic for layers, in match order.
LAYER_KEYWORDS = (
    ("api", ("controller", "api")),
    ("service", ("service", "biz")),
    ("dao", ("dao", "repository", "model")),
    ("util", ("util", "helper")),
)
# File suffix to language, in match order.
LANGUAGE_SUFFIXES = (
    (".py", "python"), (".ts", "typescript"), (".tsx", "typescript"), (".js", "javascript"), (".jsx", "javascript"),
    (".rs", "rust"), (".php", "php"), (".ex", "elixir"), (".exs", "elixir"), (".go", "go"),
)
# Conflict profiles by file suffix.
PROFILE_SUFFIXES = {"go": (".go",), "elixir": (".ex", ".exs"), "rust": (".rs",)}
# Source suffixes and directories skipped by the source scan.
SOURCE_SUFFIXES = (".ex", ".exs", ".go", ".rs", ".php", ".ts", ".tsx")
SKIPPED_DIRS = ("_build", "target", "node_modules", "deps", "__tests__")


def any_of(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def posix(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def glob_regex(glob: Column) -> Column:
    """Anchored regex of a glob: ``**`` spans folders, ``*`` stays inside one."""
    marked = F.replace(posix(glob), F.lit("**"), F.lit("\u0001"))
    quoted = F.regexp_replace(marked, r"([.+?^$()|\[\]{}\\])", r"\\$1")
    single = F.replace(quoted, F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(single, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def glob_folder(glob: Column) -> Column:
    """Literal folder that every match of the glob lies below ('' if none)."""
    return F.regexp_extract(posix(glob), r"^([^*]*/)", 1)


def folders(path: Column) -> Column:
    """All leading folders of a path, starting with ''."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def clean(path: Column) -> Column:
    """Drop ``./`` steps and doubled or trailing slashes."""
    once = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"^(\./)+", "")
    inner = F.regexp_replace(once, r"/(\./)+", "/")
    return F.regexp_replace(inner, r"(/\.)?/?$", "")


def layer_by_rules(path: Column, rules: list[tuple[str, str]]) -> Column:
    """First declared (layer, pattern) that matches, then the keyword heuristic, then ''."""
    lower = F.lower(path)
    branches = [(path.rlike(pattern.replace("*", ".*")), layer) for layer, pattern in rules]
    branches += [(any_of(lower.contains(w) for w in words), layer) for layer, words in LAYER_KEYWORDS]
    out = F.lit("")
    for test, layer in reversed(branches):
        out = F.when(test, F.lit(layer)).otherwise(out)
    return out


def file_kind(path: Column) -> Column:
    out = F.lit("other")
    for kind in reversed(FILE_KINDS):
        out = F.when(F.lower(path).contains(kind), F.lit(kind)).otherwise(out)
    return out


def language(path: Column) -> Column:
    out = F.lit("unknown")
    for suffix, name in reversed(LANGUAGE_SUFFIXES):
        out = F.when(F.lower(path).endswith(suffix), F.lit(name)).otherwise(out)
    return out


def snake(name: Column) -> Column:
    rest = F.regexp_replace(F.substr(name, F.lit(2)), r"(\p{Lu})", "_$1")
    return F.lower(F.concat(F.substring(name, 1, 1), rest))


def module_from_path(path: Column) -> Column:
    stem = F.split(file_name(path), r"\.")[0]
    bare = F.coalesce(
        F.nullif(F.regexp_extract(stem, "^(.+)(" + "|".join(MODULE_SUFFIXES) + ")$", 1), F.lit("")), stem
    )
    name = snake(bare)
    parents = F.transform(F.split(path, "/"), lambda p: F.lower(p))
    useful = F.filter(
        F.slice(parents, 1, F.greatest(F.size(parents) - 1, F.lit(0))),
        lambda p: (p != "") & ~p.isin(*GENERIC_DIRS),
    )
    return F.when(name.isin(*GENERIC_NAMES), F.coalesce(F.try_element_at(useful, F.lit(-1)), name)).otherwise(name)


def module_of(path: Column, mapping: dict[str, str]) -> Column:
    """Module of the longest mapped part that the path contains (then by name), else from the file name."""
    out = module_from_path(path)
    for part in sorted(mapping, key=lambda p: (len(p), p)):
        out = F.when(path.contains(part), F.lit(mapping[part])).otherwise(out)
    return out


def high_risk(path: Column) -> Column:
    return any_of(path.startswith(p) for p in HIGH_RISK_PREFIXES) | file_name(path).isin(*HIGH_RISK_FILES)


def is_test(path: Column) -> Column:
    lower = F.lower(path)
    return any_of(lower.contains(p) for p in TEST_PARTS) | any_of(lower.startswith(p) for p in TEST_PREFIXES)


def is_source(path: Column) -> Column:
    """Source file outside build folders and not a test by its file name."""
    name = file_name(path)
    parts = F.split(directory(path), "/")
    return (
        any_of(path.endswith(s) for s in SOURCE_SUFFIXES)
        & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIPPED_DIRS]))
        & ~any_of(name.contains(m) for m in ("_test.", ".test.", "_spec."))
    )


def is_backend(path: Column, lang: str) -> Column:
    """Business source file of one language."""
    lower = F.lower(path)
    if lang == "php":
        words = ("controller", "model", "trait", "service", "logic", "provider")
        return path.endswith(".php") & any_of(lower.contains(w) for w in words)
    if lang == "elixir":
        return (path.endswith(".ex") | path.endswith(".exs")) & (path.startswith("lib/") | path.contains("/lib/"))
    inside = lower.contains("src/") | lower.contains("lib/")
    if lang == "typescript":
        skip = any_of(lower.contains(w) for w in ("node_modules", ".test.", ".spec."))
        return (path.endswith(".ts") | path.endswith(".tsx")) & inside & ~skip
    if lang == "rust":
        skip = any_of(lower.contains(w) for w in ("target/", "/tests/", "/benches/", "/examples/"))
        return path.endswith(".rs") & inside & ~skip & ~lower.endswith("build.rs")
    raise ValueError(f"unknown language {lang!r}")


def conflict_profile(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(F.trim(path), r"(\.[^./]*)$", 1))
    out = F.lit(None).cast("string")
    for name, suffixes in PROFILE_SUFFIXES.items():
        out = F.when(suffix.isin(*suffixes), F.lit(name)).otherwise(out)
    return out
