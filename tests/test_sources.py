"""File sources and sinks."""

import json

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.sources import documents as S
from edgeloom.sources import records as J
from edgeloom.sources import store


def test_snapshot_file(spark, tmp_path):
    rec = {"sourcePath": "a\\b.ts", "localDependencies": ["c\\d.ts"], "localCallTargets": ["e.ts", "e.ts"], "relationHints": [{"target": "e.ts", "call_type_hint": "framework", "confidence": 0.9}]}
    (tmp_path / "s.json").write_text(json.dumps({"source_count": 1, "records": [rec]}, indent=1))
    records = J.read_snapshot(spark, str(tmp_path / "s.json"))
    assert rows(J.references(records)) == [("a/b.ts", "c/d.ts", "import"), ("a/b.ts", "e.ts", "call"), ("a/b.ts", "e.ts", "call")]
    assert rows(J.hint_rows(records), "src_path", "dst_path", "call_type_hint") == [("a/b.ts", "e.ts", "framework")]


def test_commit_log_file(spark, tmp_path):
    log = "__COMMIT__h1\n__MSG__fix page\n__AUTHOR__me\n__DATE__2025-12-22 10:30:00 +0800\n\n10\t5\tapp/OrderController.php\n-\t-\tlogo.png\n__COMMIT__h2\n__MSG__x\n__DATE__2025-12-23 1\n"
    (tmp_path / "log.txt").write_text(log)
    commits = J.parse_commits(J.read_commit_log(spark, str(tmp_path / "log.txt")))
    assert rows(commits, "hash", "message", "date", "total_lines", "module") == [("h1", "fix page", "2025-12-22", 15, "order"), ("h2", "x", "2025-12-23", 0, "")]
    assert rows(J.changed_files(commits), "path", "add", "kind") == [("app/OrderController.php", 10, "controller"), ("logo.png", 0, "other")]


def test_tsv_and_report(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    (tmp_path / "t.tsv").write_text("a\tb\nx\t\ny\tz\n")
    df = J.read_tsv(spark, str(tmp_path / "t.tsv"), schema)
    assert rows(df) == [("x", ""), ("y", "z")]
    J.write_tsv(df, str(tmp_path / "out"))
    assert rows(J.read_tsv(spark, str(tmp_path / "out"), schema)) == [("x", ""), ("y", "z")]
    J.write_report({"rows": df}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/rows")).count() == 2


def test_source_files(spark, tmp_path):
    for name in ("src/a.ts", "src/a.test.ts", "target/b.rs", "node_modules/x/c.ts", "d.md", "lib/e.ex"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("one\ntwo\n")
    docs = S.read_sources(spark, str(tmp_path))
    assert rows(docs, "path") == [("lib/e.ex",), ("src/a.ts",)]
    assert rows(S.numbered_lines(docs.withColumnRenamed("path", "doc")).filter("doc = 'src/a.ts'"), "line", "text") == [(1, "one"), (2, "two")]


def test_upsert_stream_keeps_other_repositories(spark, tmp_path):
    merge = store.upsert_batches(str(tmp_path / "t"), ["repo_id", "id"], "at")
    batch = lambda *r: spark.createDataFrame(r, "repo_id string, id bigint, v string, at bigint")
    merge(batch(("r1", 1, "a", 1), ("r1", 1, "b", 2), ("r2", 1, "z", 1)), 0)
    merge(batch(("r1", 1, "c", 3), ("r1", 2, "d", 3)), 1)
    table = spark.read.parquet(str(tmp_path / "t"))
    assert rows(table, "repo_id", "id", "v") == [("r1", 1, "c"), ("r1", 2, "d"), ("r2", 1, "z")]
    assert rows(store.repositories(table)) == [("r1",), ("r2",)]
    assert rows(store.without_repository(table, "r1"), "repo_id") == [("r2",)]


def test_versioned_table(spark, tmp_path):
    """Untouched buckets keep their files; a batch that is merged again changes nothing; readers of the last manifest see whole batches."""
    schema = T._parse_datatype_string("repo_id string, id bigint, v string, at bigint")
    table = store.VersionedTable(spark, str(tmp_path / "t"), schema, ["repo_id", "id"], "at", buckets=16)
    assert table.read().count() == 0
    batch = lambda *r: spark.createDataFrame(r, schema)
    table.merge(batch(*[(f"r{i % 3}", i, "a", 1) for i in range(200)]), 0)
    assert {r.batch for r in table.places().collect()} == {0} and table.places().count() == 16
    table.merge(batch(("r1", 1, "new", 2), ("r1", 1, "older", 0), ("r9", 1, "z", 1)), 1)
    places = {r.bucket: r.batch for r in table.places().collect()}
    touched = {b for b, n in places.items() if n == 1}
    assert 1 <= len(touched) <= 2 and len(places) == 16
    assert len(list((tmp_path / "t/data/batch=1").glob("bucket=*"))) == len(touched)
    want = [(f"r{i % 3}", i, "new" if i == 1 else "a", 2 if i == 1 else 1) for i in range(200)] + [("r9", 1, "z", 1)]
    assert rows(table.read()) == sorted(want, key=repr)
    table.merge(batch(("r1", 1, "new", 2), ("r1", 1, "older", 0), ("r9", 1, "z", 1)), 1)  # again, after a failure
    assert rows(table.read()) == sorted(want, key=repr)
    assert len(table.old_folders()) == len(touched)
    # A batch that wrote data but no manifest is not seen.
    (batch(("r1", 1, "half", 9)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t/data/batch=2")))
    assert rows(table.read()) == sorted(want, key=repr)


def test_fences(spark):
    text = "```dsl\na\n```\nx\n```bdd\nb"
    got = S.fenced_blocks(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert rows(got, "block", "start_line", "content", "closed") == [(1, 2, "a", True), (2, 6, "b", False)]


def test_record_envelopes(spark):
    texts = ['[{"sourcePath": "a"}]', ' {"sourcePath": "b"}', '{"records": [{"sourcePath": "c"}]}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert [r.sourcePath for r in J.parse_records(df).orderBy("sourcePath").collect()] == ["a", "b", "c"]
