"""Structured inputs and sinks: snapshots, commit logs, TSV, contracts, event payloads, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.functions import paths as P
from edgeloom.functions import text as X

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


HINT = _struct(target=_S, call_type_hint=_S, via=_S, confidence=_D, detector=_S, reason=_S)
RECORD = _struct(
    sourcePath=_S,
    localDependencies=T.ArrayType(_S),
    localCallTargets=T.ArrayType(_S),
    relationHints=T.ArrayType(HINT),
    calls=T.ArrayType(_struct(callee=_S, line=_L)),
    imports=T.ArrayType(_struct(specifier=_S, kind=_S)),
    exports_count=_L,
    imports_count=_L,
    loc_lines=_L,
    side_effects=_struct(has_async=_B, has_http=_B, has_genserver=_B, has_file_io=_B, has_pubsub=_B),
)
SNAPSHOT = _struct(source_count=_L, skipped_count=_L, records=T.ArrayType(RECORD))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """File records of JSON snapshots (object with ``records``, explicit schema)."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


def parse_records(texts: DataFrame) -> DataFrame:
    """File records of texts(value) holding an array, one object, or a ``records`` envelope."""
    value, head = F.col("value"), F.substring(F.ltrim("value"), 1, 1)
    envelope = F.from_json(value, _struct(records=T.ArrayType(RECORD)))["records"]
    single = F.from_json(value, RECORD)
    many = F.from_json(value, T.ArrayType(RECORD))
    rows = F.when(head == "[", many).otherwise(
        F.coalesce(envelope, F.when(single["sourcePath"].isNotNull(), F.array(single)))
    )
    return texts.select(F.explode(rows).alias("r")).select("r.*")


def references(records: DataFrame) -> DataFrame:
    """(src_path, dst_path, kind): one row per dependency and call target, separators normalised."""
    src = P.posix(F.col("sourcePath")).alias("src_path")
    each = lambda column, kind: records.select(src, F.explode(column).alias("d")).select("src_path", P.posix(F.col("d")).alias("dst_path"), F.lit(kind).alias("kind"))
    return each("localDependencies", "import").unionByName(each("localCallTargets", "call"))


def hint_rows(records: DataFrame) -> DataFrame:
    return records.select(P.posix(F.col("sourcePath")).alias("src_path"), F.explode("relationHints").alias("h")).select(
        "src_path", P.posix(F.col("h.target")).alias("dst_path"), "h.call_type_hint", "h.via", "h.confidence", "h.detector", "h.reason"
    )


def distinct_calls(records: DataFrame) -> DataFrame:
    """(path, callee): distinct calls per file with collapsed blanks."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    names = F.array_sort(F.array_distinct(F.transform("calls", lambda c: tidy(c["callee"]))))
    return records.select(F.col("sourcePath").alias("path"), F.explode(F.filter(names, lambda n: n != "")).alias("callee"))


def distinct_imports(records: DataFrame) -> DataFrame:
    """(path, kind, specifier): distinct imports per file, trimmed, specifiers with collapsed blanks; empty parts drop out."""
    blanks = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    ends = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = F.array_distinct(F.transform("imports", lambda i: F.struct(ends(i["kind"]).alias("kind"), blanks(i["specifier"]).alias("specifier"))))
    named = records.select(F.col("sourcePath").alias("path"), F.explode(F.array_sort(rows)).alias("i"))
    return named.select("path", "i.*").filter("kind <> '' AND specifier <> ''")


def first_calls(calls: DataFrame, order: str = "line") -> DataFrame:
    """The whole row of the first call of each callee in a file, by ``order``; of equal ones the least row.

    calls(file, callee, <order>, ...). An aggregate, so calls of one file combine before the shuffle.
    """
    rest = [c for c in calls.columns if c not in ("file", "callee", order)]
    first = F.min(F.struct(order, *rest)).alias("first")
    return calls.groupBy("file", "callee").agg(first).select("file", "callee", *[F.col(f"first.{c}").alias(c) for c in (order, *rest)])


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(value) one row per commit of a ``__COMMIT__``-separated log."""
    return spark.read.option("lineSep", "__COMMIT__").text(path)


def parse_commits(log: DataFrame) -> DataFrame:
    """Commits of log(value[, ord]) with a files array; the first record of a hash wins.

    (hash, message, author, date, total_lines, module, files[path, add, del, kind])
    """
    rows = F.split("value", "\n")
    field = lambda tag: F.coalesce(F.try_element_at(F.filter(rows, lambda r: r.startswith(tag)), F.lit(-1)), F.lit(""))
    text = lambda tag: F.substr(field(tag), F.lit(len(tag) + 1))
    numstat = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: ~r.startswith("__") & (F.size(F.split(r, "\t")) == 3))
    count = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))

    def one(r: Column) -> Column:
        p = F.split(r, "\t")
        return F.struct(p[2].alias("path"), count(p[0]).alias("add"), count(p[1]).alias("del"), P.file_kind(p[2]).alias("kind"))

    order = F.col("ord") if "ord" in log.columns else F.lit(0)
    parsed = log.select(
        F.trim(rows[0]).alias("hash"), text("__MSG__").alias("message"), text("__AUTHOR__").alias("author"),
        F.split(F.trim(text("__DATE__")), r"\s+")[0].alias("date"), F.transform(numstat, one).alias("files"), order.alias("_ord"),
    ).filter("hash <> ''")
    first = parsed.groupBy("hash").agg(F.min_by(F.struct("message", "author", "date", "files"), "_ord").alias("c")).select("hash", "c.*")
    total = F.aggregate("files", F.lit(0).cast("bigint"), lambda a, f: a + f["add"] + f["del"])
    module = F.coalesce(P.module_from_path(F.try_element_at("files", F.lit(1))["path"]), F.lit(""))
    return first.select("hash", "message", "author", "date", total.alias("total_lines"), module.alias("module"), "files")


def changed_files(commits: DataFrame) -> DataFrame:
    return commits.select("hash", F.explode("files").alias("f")).select("hash", "f.*")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """TSV with header; missing cells become ''."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    text = [f.name for f in schema.fields if f.dataType == _S]
    return rows.fillna("", text)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON table per report part (summary, findings, ...)."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def contract_edges(contracts: DataFrame, column: str) -> DataFrame:
    """Edge rows of a contract document column such as allow_edges or forbid_edges."""
    return contracts.select(F.explode(column).alias("e")).select("e.*")


PAYLOAD = _struct(
    action=_S, label=_struct(name=_S), client_payload=_struct(event_source=_S), pull_request=_struct(merged=_B)
)


def event_fields(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds label, action, source, merged and ``bad_payload`` (text that is not a JSON object)."""
    p = F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE"})
    broken = F.try_parse_json(payload).isNull()
    return events.withColumn("_p", p).select(
        *events.columns,
        F.trim(F.coalesce("_p.label.name", F.lit(""))).alias("label"),
        F.trim(F.coalesce("_p.action", F.lit(""))).alias("action"),
        F.trim(F.coalesce("_p.client_payload.event_source", F.lit(""))).alias("source"),
        F.coalesce("_p.pull_request.merged", F.lit(False)).alias("merged"),
        F.coalesce(broken, F.lit(True)).alias("bad_payload"),
    )


# Severity by external-tool priority.
CRITICAL_PRIORITY, WARNING_PRIORITY = 20, 10


def parse_list_linter(outputs: DataFrame, source: str) -> DataFrame:
    """Findings of outputs(value) shaped ``[{code, message, filename, row}]``; rows without a required field drop."""
    item = T.ArrayType(_struct(code=_S, message=_S, filename=_S, row=_L))
    rows = outputs.select(F.explode(F.from_json("value", item)).alias("i")).select("i.*").dropna(subset=["code", "message", "filename"])
    return rows.select(
        F.lit("lint").alias("category"), F.col("code").alias("rule"), F.lit("warning").alias("severity"), "message", F.col("filename").alias("file"),
        F.coalesce("row", F.lit(0)).alias("line"), F.lit(source).alias("source"), F.lit(1.0).alias("confidence"),
    )


def parse_issue_linter(outputs: DataFrame, source: str) -> DataFrame:
    """Findings of outputs(value) shaped ``{issues: [{category, message, filename, line_no, priority}]}``."""
    item = _struct(issues=T.ArrayType(_struct(category=_S, message=_S, filename=_S, line_no=_L, priority=_L)))
    rows = outputs.select(F.explode(F.from_json("value", item)["issues"]).alias("i")).select("i.*").dropna(subset=["category", "message", "filename"])
    level = F.coalesce("priority", F.lit(0))
    return rows.select(
        "category", F.concat(F.lit("credo_"), F.lower("category")).alias("rule"),
        F.when(level >= CRITICAL_PRIORITY, "critical").when(level >= WARNING_PRIORITY, "warning").otherwise("info").alias("severity"),
        "message", F.col("filename").alias("file"), F.coalesce("line_no", F.lit(0)).alias("line"), F.lit(source).alias("source"), F.lit(1.0).alias("confidence"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src_path, dst_path, kind) of the href targets of pages(url, html)."""
    return pages.select(F.col("url").alias("src_path"), F.explode(X.all_matches(F.col("html"), r'href="([^"]+)"')).alias("dst_path"), F.lit("import").alias("kind"))
