"""Text inputs: files, numbered lines, fenced blocks, scenario segments, diffs, comment markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.functions import text as X

def _in_doc(last: int):
    """Lines of the document up to ``last`` rows from here.

    A document is one row of its source, so its lines fit one task.
    """
    return Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, last)


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of source files below a folder; tests and build folders are left out.

    The suffix filter runs while listing, so other files are never opened.
    """
    suffixes = ",".join(s[1:] for s in P.SOURCE_SUFFIXES)
    files = spark.read.text(
        folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{{{suffixes}}}"
    ).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("text"))
    inside = F.regexp_replace("path", r"^\Q" + folder.rstrip("/") + r"\E/", "")
    return files.select(inside.alias("path"), "text").filter(P.is_source(F.col("path")))


def numbered_lines(docs: DataFrame, key: str = "doc") -> DataFrame:
    """(key, line, text) with lines counted from 1."""
    return docs.select(key, F.posexplode(X.lines(F.col("text"))).alias("pos", "text")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("line"), "text"
    )


def fenced_lines(lines: DataFrame) -> DataFrame:
    """Lines with fence state: block number, and whether the line opens, closes or lies inside.

    An opening fence always leads inside and a plain fence always leads outside,
    so the state before a line is the kind of the last fence above it.
    """
    bare = F.rtrim("text")
    kind = F.when(bare.rlike(r"(?i)^\s*```(bdd|dsl|bdd-dsl)\s*$"), "open").when(bare.rlike(r"^\s*```\s*$"), "close")
    marked = lines.withColumn("kind", kind).withColumn("before", F.last("kind", ignorenulls=True).over(_in_doc(-1)))
    inside = F.coalesce(F.col("before") == "open", F.lit(False))
    opens = (F.col("kind") == "open") & ~inside
    rows = marked.select(
        "doc", "line", "text", F.coalesce(opens, F.lit(False)).alias("opens"),
        F.coalesce((F.col("kind") == "close") & inside, F.lit(False)).alias("closes"), inside.alias("inside"),
    )
    return rows.withColumn("block", F.sum(F.col("opens").cast("bigint")).over(_in_doc(0)))


def fenced_blocks(docs: DataFrame) -> DataFrame:
    """(doc, block, start_line, content, closed): content and closed=false marks an unclosed fence."""
    fenced = docs.filter(F.col("text").rlike(r"(?im)^\s*```(bdd|dsl|bdd-dsl)\s*$"))
    rows = fenced_lines(numbered_lines(fenced)).filter("opens OR inside")
    body = F.when(F.col("inside") & ~F.col("closes"), F.struct("line", "text"))
    return (
        rows.groupBy("doc", "block")
        .agg(
            (F.min(F.when(F.col("opens"), F.col("line"))) + 1).alias("start_line"),
            F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda r: r["text"]), "\n").alias("content"),
            F.bool_or("closes").alias("closed"),
        )
    )


HEADER = r"^\[SCENARIO:\s*([^\]]+)\]\s*(.*)$"
STEP = r"^(GIVEN|WHEN|THEN)\s+(\S+)\s*(.*)$"


def scenario_lines(docs: DataFrame) -> DataFrame:
    """(doc, segment, line, text, is_header); segment 0 holds steps before any header; blanks and # lines are skipped."""
    rows = numbered_lines(docs).withColumn("text", F.trim("text")).filter("text <> '' AND NOT startswith(text, '#')")
    rows = rows.withColumn("is_header", F.startswith("text", F.lit("[SCENARIO:")))
    return rows.withColumn("segment", F.sum(F.col("is_header").cast("bigint")).over(_in_doc(0)))


def with_scenarios(docs: DataFrame) -> DataFrame:
    """Documents without a header hold no scenario; their lines never reach a shuffle."""
    return docs.filter(F.contains("text", F.lit("[SCENARIO:")))


def _header() -> list[Column]:
    rest = F.regexp_extract("text", HEADER, 2)
    title = F.trim(F.regexp_replace(F.regexp_extract(rest, r"TITLE:\s*(.*)$", 1), r"\s*TAGS:.*$", ""))
    tags = F.filter(F.split(F.trim(F.regexp_extract(rest, r"TAGS:\s*(.*)$", 1)), r"\s+"), lambda x: x != "")
    return [F.trim(F.regexp_extract("text", HEADER, 1)).alias("id"), title.alias("title"), tags.alias("tags")]


def _step() -> list[Column]:
    pairs = X.all_matches(F.regexp_extract("text", STEP, 3), r"""(\w+=(?:"[^"]*"|\S+))""")
    args = F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1), F.regexp_replace(F.regexp_extract(p, r"=(.*)$", 1), '^"|"$', "")),
        )
    )
    return [
        F.lower(F.regexp_extract("text", STEP, 1)).alias("kind"), F.regexp_extract("text", STEP, 2).alias("name"), args.alias("args"), F.col("text").alias("raw"),
    ]


def scenarios(docs: DataFrame) -> DataFrame:
    """(doc, segment, line, id, title, tags)."""
    return scenario_lines(with_scenarios(docs)).filter("is_header").select("doc", "segment", "line", *_header())


def steps(docs: DataFrame) -> DataFrame:
    """(doc, segment, line, kind, name, args, raw); args is a string map of key=value pairs."""
    return scenario_lines(with_scenarios(docs)).filter("NOT is_header AND segment > 0").select("doc", "segment", "line", *_step())


def scenario_blocks(docs: DataFrame) -> DataFrame:
    """One row for each scenario: (doc, segment, line, id, title, tags, steps); steps are the texts [line, text] below the header.

    Lines are numbered and cut at the headers inside their document's row, so neither a sort nor a shuffle is needed.
    """
    numbered = F.transform(X.lines(F.col("text")), lambda x, i: F.struct((i + 1).cast("bigint").alias("line"), F.trim(x).alias("text")))
    kept = F.filter(numbered, lambda x: (x["text"] != "") & ~F.startswith(x["text"], F.lit("#")))
    rows = with_scenarios(docs).select("doc", kept.alias("kept"))
    heads = F.filter(F.transform("kept", lambda x, i: F.when(F.startswith(x["text"], F.lit("[SCENARIO:")), i + 1)), lambda i: i.isNotNull())
    rows = rows.select("doc", "kept", F.concat(heads, F.array(F.size("kept") + 1)).alias("heads"))
    # the last place only ends the last scenario
    cuts = F.transform(F.slice("heads", 1, F.size("heads") - 1), lambda h, k: F.struct((k + 1).cast("bigint").alias("segment"), F.col("kept")[h - 1].alias("head"), F.slice("kept", h + 1, F.col("heads")[k + 1] - h - 1).alias("steps")))
    found = rows.select("doc", F.explode(cuts).alias("c")).select("doc", "c.segment", "c.head.line", "c.head.text", "c.steps")
    return found.select("doc", "segment", "line", *_header(), "steps")


def scenario_rows(docs: DataFrame) -> DataFrame:
    """Headers and steps of :func:`scenario_blocks` as rows: (doc, segment, line, is_header, scenario, kind, name, args, raw).

    ``scenario`` [id, title, tags] is the header above a step. A header's step columns are null.
    """
    blocks = scenario_blocks(docs).select("doc", "segment", F.struct("id", "title", "tags").alias("scenario"), F.concat(F.array(F.struct("line", F.lit(None).cast("string").alias("text"))), "steps").alias("rows"))
    rows = blocks.select("doc", "segment", "scenario", F.explode("rows").alias("r")).select("doc", "segment", "r.line", "scenario", "r.text")
    step = F.when(F.col("text").isNotNull(), F.struct(*_step())).alias("step")
    return rows.select("doc", "segment", "line", F.col("text").isNull().alias("is_header"), "scenario", step).select("doc", "segment", "line", "is_header", "scenario", "step.*")


def stray_steps(docs: DataFrame) -> DataFrame:
    """Steps before any header: error rows."""
    return scenario_lines(docs).filter("segment = 0").select("doc", "line", F.lit("step_before_header").alias("error"), "text")


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(doc, file, line_no) of added lines, counted on the new side of a unified diff.

    diffs(doc, text). Context lines advance the count, removed lines do not. Both are counted inside the diff's row,
    without a shuffle or sort of lines: with removed lines left out, a line is as many places behind its hunk's header as
    the count has advanced. Headers and ``diff --git`` lines cut the rest into pieces; a piece that starts at a header
    takes the path above it, one that starts at a path goes on from the header above it.
    """
    is_header = lambda x: F.startswith(x, F.lit("@@ "))
    removed = lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))
    added = lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))
    path = lambda x: F.nullif(F.regexp_extract(x, r"^diff --git a/\S+ b/(\S+)", 1), F.lit(""))
    start = lambda x: F.when(is_header(x), F.coalesce(F.nullif(F.regexp_extract(x, r"\+(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")))
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    rows = diffs.filter(F.col("text").rlike(r"(?m)^\+")).select("doc", F.filter(X.lines(F.col("text")), lambda x: ~removed(x)).alias("kept"))
    marks = known(F.transform("kept", lambda x, i: F.when(is_header(x) | F.startswith(x, F.lit("diff --git ")), F.struct(i.alias("at"), start(x).alias("start"), path(x).alias("path")))))
    marks = F.filter(marks, lambda m: m["start"].isNotNull() | m["path"].isNotNull())
    # a mark before the first line stands for both kinds, so every mark has a header and a path at or above it
    top = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("string").alias("path")))
    rows = rows.select("doc", "kept", F.concat(top, marks).alias("marks"))
    ended = F.transform("marks", lambda m, i: F.struct(m["at"].alias("at"), F.coalesce(F.get("marks", i + 1)["at"], F.size("kept")).alias("until"), m["start"].alias("start"), m["path"].alias("path")))
    rows = rows.select("doc", "kept", ended.alias("marks"))
    heads = known(F.transform("marks", lambda m, i: F.when(m["start"].isNotNull(), i)))
    files = known(F.transform("marks", lambda m, i: F.when((i == 0) | m["path"].isNotNull(), i)))
    rows = rows.select("doc", "kept", "marks", heads.alias("heads"), files.alias("files"))
    group = lambda at, k, of: F.slice("marks", at + 1, F.coalesce(F.get(of, k + 1), F.size("marks")) - at)
    piece = lambda m, head, file: F.struct(m["at"].alias("at"), m["until"].alias("until"), head["at"].alias("head"), head["start"].alias("start"), file["path"].alias("file"))
    at_head = F.transform("files", lambda f, k: F.transform(F.filter(group(f, k, "files"), lambda m: m["start"].isNotNull()), lambda m: piece(m, m, F.get("marks", f))))
    at_path = F.transform("heads", lambda h, k: F.transform(F.filter(group(h, k, "heads"), lambda m: m["start"].isNull()), lambda m: piece(m, F.get("marks", h), m)))
    rows = rows.select("doc", "kept", F.flatten(F.concat(at_head, at_path)).alias("pieces"))
    numbers = lambda p: known(F.transform(F.slice("kept", p["at"] + 2, p["until"] - p["at"] - 1), lambda x, j: F.when(added(x), p["start"] + (p["at"] + j - p["head"]))))
    found = rows.select("doc", F.explode(F.transform("pieces", lambda p: F.struct(p["file"].alias("file"), numbers(p).alias("lines")))).alias("p"))
    return found.select("doc", F.col("p.file").alias("file"), F.explode("p.lines").alias("line_no"))


def markers(comments: DataFrame) -> DataFrame:
    """First marker of every comment line, unknown types dropped.

    (issue_key, pos, line, type, issue, rev, pr, finish, decision, human, risk, dcount, mode, label, action, actor, akey)
    from comments(issue, pos, body).
    """
    rows = comments.select(F.col("issue").alias("issue_key"), "pos", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    # the first well-formed marker of a line counts: type, then only key=value words
    found = F.transform(X.all_matches(F.col("text"), X.MARKER), lambda x: F.split(F.trim(x), r"\s+"))
    well = F.filter(found, lambda w: F.forall(F.slice(w, 2, F.size(w)), lambda x: x.rlike(r"^\w+=\S+$")))
    rows = rows.filter(F.contains("text", F.lit("<!--"))).select(
        "issue_key", "pos", (F.col("line") + 1).cast("bigint").alias("line"), F.try_element_at(well, F.lit(1)).alias("words")
    )
    pair = lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1).alias("k"), F.regexp_extract(p, r"^\w+=(.*)$", 1).alias("v"))
    rows = rows.withColumn("type", F.try_element_at("words", F.lit(1))).filter(F.col("type").isin(*X.MARKER_TYPES))
    rows = rows.withColumn("kv", F.transform(F.slice("words", 2, F.size("words")), pair))
    value = lambda k: F.try_element_at(F.filter("kv", lambda p: p["k"] == k), F.lit(-1))["v"]
    # a bad integer is ignored, so the last good one stays
    number = lambda k: F.coalesce(F.try_element_at(F.filter(F.transform(F.filter("kv", lambda p: p["k"] == k), lambda p: p["v"].try_cast("bigint")), lambda n: n.isNotNull()), F.lit(-1)), F.lit(0))
    flag = lambda k: F.exists("kv", lambda p: (p["k"] == k) & p["v"].isin("1", "true"))
    word = lambda k: F.coalesce(value(k), F.lit(""))
    return rows.select(
        "issue_key", "pos", "line", "type", number("issue").alias("issue"), number("rev").alias("rev"), number("pr").alias("pr"), flag("finish").alias("finish"),
        word("decision").alias("decision"), flag("human").alias("human"), word("risk").alias("risk"), number("dcount").alias("dcount"), word("mode").alias("mode"),
        word("label").alias("label"), word("action").alias("action"), word("actor").alias("actor"), word("akey").alias("akey"),
    )
