"""Column functions on single values, including long texts that break recursive patterns."""

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import labels as L
from edgeloom.functions import paths as P
from edgeloom.functions import text as X
from edgeloom.operators import clones as K
from edgeloom.operators import findings as D
from edgeloom.operators import relations as R
from edgeloom.sources import documents as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("src/**", "src/b/a.ts", True), ("a+b/?.x", "a+b/?.x", True), ("a.c", "abc", False),
        ("**/x[1].go", "q/r/x[1].go", True),
    ],
)
def test_glob(spark, glob, path, hit):
    got = spark.createDataFrame([(glob, path)], "g string, p string").select(F.regexp_like("p", P.glob_regex(F.col("g"))).alias("r")).first().r
    assert got is hit


@pytest.mark.parametrize(
    "path, module",
    [
        ("app/controllers/OrderItemController.php", "order_item"), ("lib/shop/order/index.ex", "order"), ("src/PayService.ts", "pay"), ("main.go", "main"), ("lib/app/base.ex", "base"),
        ("src/cart_handler.ex", "cart"), ("Service.php", "service"),
    ],
)
def test_module_names(spark, path, module):
    assert one(spark, path, P.module_from_path) == module


@pytest.mark.parametrize("raw, clean", [("./a/b", "a/b"), ("a//b/", "a/b"), ("a/./b", "a/b"), ("a/././b", "a/b"), ("a", "a")])
def test_clean(spark, raw, clean):
    assert one(spark, raw, P.clean) == clean


def test_references(spark):
    assert one(spark, "Merge pull request #9: closes #3, sub( #7 ) parent(#3) (#12) #99 refs #0", lambda c: X.issue_refs(c)) == [3, 7, 12]
    assert one(spark, "#1 #1 #2 #1", X.commit_refs) == [1, 1 + 1, 1]
    assert one(spark, "x\nDepends on: #4, #5 #6 7 #8", X.depends_on) == [4, 5, 6]
    assert one(spark, "depends-on: a/b#4, #5\nblocked by: #4 and #9", lambda c: X.depends_on(c, "multi")) == [4, 5, 9]
    assert one(spark, "Parent issue: #12", X.parent_issue) == 12
    assert one(spark, "A:  Big_Plan -- For 30 characters and more", X.slug) == "a-big-plan-for-30-characters-a"


def test_long_texts_do_not_overflow(spark):
    many = "depends on: " + "#1 " * 60000
    assert len(one(spark, many, X.depends_on)) == 60000
    words = " ".join(["word", "12", '"s"'] * 60000)
    assert one(spark, words, lambda c: K.skeleton(K.marked(c))) == "$ "
    assert one(spark, "A." * 60000 + "b", R.module_refs) == [("A." * 60000)[:-1]]
    marker = "<!-- BOT:LABEL_GUARD " + "k=v " * 60000 + "issue=4 -->"
    df = spark.createDataFrame([(4, 0, marker)], "issue bigint, pos bigint, body string")
    assert S.markers(df).first().issue == 4


def test_labels(spark):
    split = lambda f: (lambda c: f(F.split(c, ",")))
    assert one(spark, "bot:fix,bug,bot:fix,bot:done", split(L.states)) == ["bot:fix", "bot:done"]
    assert one(spark, "bot:fix,bot:what", split(L.current)) == "invalid"
    assert one(spark, "bot:done,bot:plan-draft,bot:queued", split(L.healed)) == "bot:plan-draft"


@pytest.mark.parametrize(
    "line, rule",
    [
        ('api_key = "abcd1234efgh"', "hardcoded_credential"), ('password = "Enter your password"', None), ('api_key = os.environ["abcdefgh"]', None),
        ('cursor.execute("a" + b)', "injection_risk"), ("yaml.safe_load(f)", None), ("eval(x)", "injection_risk"), ("hashlib.sha1(x)", "weak_crypto"),
        ('logger.info("token", secret)', "sensitive_data_log"),
    ],
)
def test_security_rules(spark, line, rule):
    df = spark.createDataFrame([("src/a.py", "python", 1, line)], "file string, lang string, line bigint, text string")
    assert [r.rule for r in D.scan(df, D.security_rules()).collect()] == ([rule] if rule else [])


def test_translation_and_test_paths_are_skipped(spark):
    line = 'api_key = "abcd1234efgh"'
    df = spark.createDataFrame([(p, "python", 1, line) for p in ("src/i18n/a.py", "tests/a.py")], "file string, lang string, line bigint, text string")
    assert D.scan(df, D.security_rules()).count() == 0
