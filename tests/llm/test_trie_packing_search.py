"""Prefix trie, grouped packing and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import SCHEMA, WORDS, clashing, none, rows_of, small, split_words  # noqa: F401
from oracle import DATA, compare, duck
from pyspark.sql import functions as F

from edgeloom.llm import grouped_packing, prefix_trie, term_pipeline
from edgeloom.llm.long_texts import text_parts
from edgeloom.llm.queries import ORACLE, QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def make_turns(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue  # an absent base now and then
        old = [r for r in rows if r[0] == rng.randrange(n)]
        told = [(r[2], r[3]) for r in old] if old and rng.random() < 0.5 else []
        told += [(rng.choice(["user", None, ""]), rng.choice([None, "", "a b", "c", "d e f"])) for _ in range(rng.randrange(1, 7))]
        at = [None, *range(len(told) - 1)] if rng.random() < 0.2 else list(range(len(told)))
        rows += [(c, t, *x) for t, x in zip(at, told)]
    rows += [(None, 0, "user", "without a conversation")]
    rng.shuffle(rows)
    return rows


def strings_of(rows, rebuild):
    told = {}
    for c, t, role, text in rows:
        if c is not None:
            told.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    told = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in told.items()}
    if not rebuild:
        return told
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = told.get(c - c % 20, [])[:h] + own[h:]
    return out


def nodes_of(strings):
    members = {}
    for c, s in strings.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, who in members.items():
        worth = (len(who) - 1) * len(split_words(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += worth
    out = []
    for k, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(strings[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(who), len(k), parent, len(who), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("segment", [1024, 2])
def test_trie(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 3)
    rows = make_turns(segment)
    turns = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({c: F.lit("x") for c in ("sig", "edge", "part", "copy", "top", "depth", "a", "n", "least")})
    got = prefix_trie.trie_nodes(prefix_trie.rebuilt_turns(turns))
    assert got.columns == list(NODE)
    assert sorted(rows_of(got), key=repr) == nodes_of(strings_of(rows, True))


def test_trie_of_copies_prefixes_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 64)
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(c % 7)]  # each a prefix of the next, many copies
    rows += [(90, t, "user", f"turn {t}") for t in range(300)] + [(91, t, "user", f"turn {t}" if t < 200 else "other") for t in range(230)]
    rows += [(92, 5, "user", "same turn")] * 3
    turns = spark.createDataFrame(rows, TURNS)
    assert sorted(rows_of(prefix_trie.trie_nodes(prefix_trie.plain_turns(turns))), key=repr) == nodes_of(strings_of(rows, False))


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([(None, 1, "user", "a")], TURNS)
    assert prefix_trie.trie_nodes(prefix_trie.rebuilt_turns(turns)).count() == 0
    assert prefix_trie.trie_nodes(prefix_trie.rebuilt_turns(turns.limit(0))).count() == 0


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_packed(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    want = []
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), capacity):
            piece = ids[p : p + capacity]
            want.append((i, p // capacity, p, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(w[3] for w in want) // capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_round_trip(spark, small, clashing, capacity):  # noqa: F811
    rows = small[0] + [(900, "Plain <|endoftext|> mark, it's KEPT é é 中文 don't", None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("length", "rank", "shard", "piece", "at", "n")})
    got = grouped_packing.pack(docs, tokenizer(), capacity, keep_ids=True).collect()
    n, least = check_packed(got, [(r[0], r[1]) for r in rows], capacity)
    assert n <= math.ceil(least * 1.1) + 1
    assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32 for r in got)


def test_packing_of_nothing_string_ids_and_a_long_text(spark, none):  # noqa: F811
    assert grouped_packing.pack(none, tokenizer()).count() == 0
    long = ("sing 12 songs " * 90_000 + "x" * 3000 + "\n") * 2
    docs = spark.createDataFrame([("a", long), ("b", None), ("b", None)], "doc_id string, text string")
    got = grouped_packing.pack(docs, tokenizer()).collect()
    check_packed(got, [("a", long), ("b", None), ("b", None)], 2048)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(*r) for r in (rng.choice([(1, 40), (300, 900), (20, 1000), (400, 700)]) for _ in range(rng.choice([3, 500, 3000])))]
    histogram = dict(Counter(lengths))
    patterns = grouped_packing.plan(histogram, 1000, groups=24)
    held = Counter()
    for n, pieces in patterns:
        assert n > 0 and sum(k * v for k, v in pieces.items()) <= 1000
        for k, v in pieces.items():
            held[k] += n * v
    assert held == Counter(histogram)
    assert sum(n for n, _ in patterns) <= first_fit(lengths, 1000) * 1.02 + 1
    places = set()
    at = grouped_packing.seats(patterns)
    for i in range(len(at["length"])):
        until = histogram[at["length"][i]] if i + 1 == len(at["length"]) or at["length"][i + 1] != at["length"][i] else at["rank"][i + 1]
        for nth in range(until - at["rank"][i]):
            places.add((int(at["sequence"][i] + nth // at["each"][i]), int(at["offset"][i] + nth % at["each"][i] * at["length"][i])))
    assert len(places) == len(lengths)


def first_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        k = next((i for i, b in enumerate(bins) if b + x <= capacity), None)
        if k is None:
            bins.append(x)
        else:
            bins[k] += x
    return len(bins)


def test_configurations_meet_the_program():
    import numpy as np

    sizes, demand = np.array([60, 50, 40, 30]), np.array([10.0, 8.0, 20.0, 30.0])
    columns, times = grouped_packing.configurations(sizes, demand, 100)
    assert np.allclose(columns @ times, demand) and (sizes @ columns <= 100).all()
    assert times.sum() == pytest.approx(27.0, abs=1.0) and times.sum() >= sizes @ demand / 100


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search_of(docs, items, top):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b in bags:
            n, s = sum(b.values()), 0
            for t in terms & b.keys():
                m = 50 + 50 * n * n_docs // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m))
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["sent", "joined", "bundles"])
def test_search(spark, monkeypatch, case):
    if case == "joined":
        monkeypatch.setattr(term_pipeline, "TERMS_TO_SEND", 0)
    if case == "bundles":
        monkeypatch.setattr(term_pipeline, "ITEMS_PER_BUNDLE", 3)
        monkeypatch.setattr(term_pipeline, "SHARD_DOCS", 16)
    rng = random.Random(case)
    common = ["the", "of", "Été", "中文"]
    say = lambda k: " ".join(rng.choice(common if rng.random() < 0.4 else WORDS) for _ in range(k))
    docs = [(i, rng.choice([None, "", ". -", *[say(rng.randrange(1, 60)) for _ in range(9)]])) for i in range(150)]
    docs += [docs[5], docs[5], (None, say(20)), (400, "The-THE.the éÉ the_of x" + " ba ko, da" * 150_000 + "\n" + say(50))]
    items = [(i, say(rng.randrange(1, 12))) for i in range(8)] + [(3, "the extra Words"), (8, None), (9, "nowhere-to-be-found"), (None, "the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("shard", "term", "score", "rank", "item_id", "bundle")})
    got = term_pipeline.search(frame, spark.createDataFrame(items, "item_id long, text string").withColumn("slot", F.lit(1)), top=10, owners=3)
    assert sorted(rows_of(got)) == search_of(docs, items, 10)


def test_search_of_nothing(spark, none):  # noqa: F811
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert term_pipeline.search(none, items).count() == 0
    docs = spark.createDataFrame([(1, "word"), (2, "words only")], "doc_id long, text string")
    assert term_pipeline.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in term_pipeline.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_parts_end_at_separators():
    import numpy as np
    import pyarrow as pa

    breaks = np.zeros(256, bool)
    breaks[32] = True
    texts = ["ab cd " * 50, None, "", "x" * 200, ("y" * 30 + " ") * 40]
    batch = pa.record_batch({"text": pa.array(texts)})
    back = {}
    for rows, data, bounds in text_parts(batch, breaks, size=16):
        for r, a, b in zip(rows, bounds, bounds[1:]):
            piece = data[a:b].tobytes()
            assert not back.get(r) or piece[:1] == b" "
            back[r] = back.get(r, b"") + piece
    assert {r: v.decode() for r, v in back.items() if v} == {r: t for r, t in enumerate(texts) if t}


@pytest.mark.parametrize("name", ["op1_line_templates", "op11_prefix_trie", "op13_term_pipeline"])
def test_sql_at_the_next_size(spark, name):
    sf_dir = f"{DATA}/sf0.01"
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name]) is None


def test_search_reads_texts_in_shards(spark, monkeypatch):
    """The index gets batches of at most one shard, and the session keeps its own batch size."""
    from edgeloom.llm import term_pipeline

    whole, most = term_pipeline._index, term_pipeline.SHARD_DOCS

    def index(wanted, doc_type):
        work = whole(wanted, doc_type)

        def checked(batches):
            for batch in batches:
                if batch.num_rows > most:
                    raise ValueError(f"a batch of {batch.num_rows} texts")
                yield batch

        return lambda batches: work(checked(batches))

    monkeypatch.setattr(term_pipeline, "_index", index)
    docs = spark.range(5000, numPartitions=1).selectExpr("id as doc_id", "concat('w', id % 9) as text")
    items = spark.createDataFrame([(1, "w3 w4")], "item_id bigint, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert term_pipeline.search(docs, items).count() == 50
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
