"""Small tables and helpers that the tests of this folder share."""

import random
import re

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ba", "ko", "lu", "mi", "ne", "ra", "so", "ti") for b in ("da", "fe", "go", "la", "pu", "ri", "sa", "to")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def make_docs(seed, n=60):
    """Small texts with nulls, empties, one long text, shared passages, exact and near copies, and repeated rows."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    shared = [say(50), say(40)]
    texts = [None, "", " \n\t ", "one", "two words", say(4000)]
    while len(texts) < n:
        kind = rng.random()
        old = [t for t in texts if t and len(t) > 40]
        if kind < 0.2:
            texts.append(say(rng.randrange(5, 30)) + " " + rng.choice(shared) + "\n" + say(rng.randrange(5, 30)))
        elif kind < 0.35:
            texts.append(rng.choice(old))
        elif kind < 0.6:
            words = rng.choice(old).split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        else:
            texts.append("\n".join(say(rng.randrange(3, 40)).capitalize() for _ in range(rng.randrange(1, 5))))
    rng.shuffle(texts)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[0], None, None, None), (None, "no id at all", None, None, None)]
    return rows


@pytest.fixture(scope="session")
def small(spark):
    rows = make_docs(5)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(small):
    """The same rows with columns named like the operators' own."""
    names = ("row_key", "hash", "owner", "place", "starts", "anchors", "set_key", "root", "score", "predicted", "held_out", "bucket", "n", "w", "t", "gone", "lines", "found", "item_id", "hits", "y")
    return small[1].withColumns({c: F.lit("x") for c in names})


def rows_of(df):
    return [tuple(r) for r in df.collect()]
