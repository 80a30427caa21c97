"""Operators on texts against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, line_templates, packing, secret_scan, set_join, substrings, surrogates
from llm_cases import clashing, none, rows_of, small, split_words  # noqa: F401


def removed_by_hand(texts, length):
    words = [split_words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [35, 10, 3])
def test_substrings(small, length):
    rows, docs = small
    want = Counter((r[0], *x) for r, x in zip(rows, removed_by_hand([r[1] for r in rows], length)))
    assert Counter(rows_of(substrings.remove_repeats(docs, length, keep_text=False))) == want


def test_substrings_keep_text_and_edges(small, none, clashing):
    rows, docs = small
    full = substrings.remove_repeats(docs, 10).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in full)
    assert substrings.remove_repeats(none, 35).count() == 0
    assert Counter(rows_of(substrings.remove_repeats(clashing, 10, False))) == Counter(rows_of(substrings.remove_repeats(docs, 10, False)))


def test_cover_meets_every_shift():
    for period, cover in substrings.COVERS.items():
        for shift in range(period):
            assert any((a + shift) % period in cover for a in cover)


def components_by_hand(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = split_words((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for r, g in zip(rows, group):
        least[g].append(r[0])
    pick = lambda ids: min((i for i in ids if i is not None), default=None)
    return Counter((r[0], len(s), pick(least[g])) for r, s, g in zip(rows, sets, group))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 60)])
def test_set_join(small, n, percent):
    rows, docs = small
    assert Counter(rows_of(set_join.similar_documents(docs, n, percent))) == components_by_hand(rows, n, percent)


def test_set_join_heavy_clusters(spark):
    """Every cluster too heavy for a task: leaders and their differences find the same components."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(rows_of(set_join.similar_documents(docs, 3, 80, weight=10))) == components_by_hand(rows, 3, 80)


def test_set_join_edges(small, none, clashing):
    rows, docs = small
    assert set_join.similar_documents(none).count() == 0
    assert Counter(rows_of(set_join.similar_documents(clashing, 3, 90))) == components_by_hand(rows, 3, 90)
    kept = set_join.keep_one_of_each(clashing, 3, 90)
    assert kept.columns == clashing.columns
    want = components_by_hand(rows, 3, 90)
    alive = {c for (d, n, c), _ in want.items() if n}
    got = [r.doc_id for r in kept.where("trim(coalesce(text, '')) <> '' and not text rlike '^\\\\s*$'").collect()]
    assert sorted(x for x in got if x is not None) == sorted(x for x in alive if x is not None)


def test_allocation_covers_the_limit():
    for band in range(20):
        for sets in (1, 10**3, 10**8):
            m, wide = set_join.allocation(band, sets, 80)
            assert m + wide > set_join.limit(2 * (set_join.band_low(band + 1) - 1), 80)


@pytest.mark.parametrize("size", [60, 130, 190, 291])
def test_segments_of_nothing_are_no_meeting(size):
    """Sets with no common element share no key in a band of many sets; pairs just at the similarity always share one."""
    rng = np.random.default_rng(size)
    band = set_join.band_of(size)
    plan = set_join.allocation(band, 140_000, 80)
    assert plan[1], "a band of many sets has wide segments"
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    keys = lambda s: set(set_join.segment_keys(s, band, *plan, 80).tolist())
    met = Counter(k for _ in range(300) for k in keys(draw(size)))
    assert max(met.values()) <= 6
    for _ in range(300):
        both, own = draw(size), size // 9  # 100 * (size - own) >= 80 * (size + own)
        other = np.sort(np.r_[both[own:], draw(own)])
        assert keys(both) & keys(other)


def test_line_templates(spark, small, none, clashing):
    rows = [(i, f"Title {i} about {'xyz'[i % 3]}{i}\nUser {i} logged in from {'Paris' if i % 4 else 'Lyon'} today\nplain words number {'abcdefghij'[i]}") for i in range(10)]
    rows += [(20, "Own long line that nobody else has\nAll rights reserved."), *[(30 + i, f"{'q' * (60 + i)} {i}\nAll rights reserved.") for i in range(5)]]
    rows += [(50 + i, "copied line one is the longest here\ncopied line two") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert got[0].text.count("\n") == 2 and "logged in" in got[1].text and "logged in" not in got[2].text and "rights" in got[20].text
    assert all("rights" not in got[30 + i].text for i in range(5))
    assert all(got[50 + i].n_removed == 0 for i in range(8)), "copies of one document are no recurrence"
    assert line_templates.drop_recurring_lines(none).count() == 0
    out = line_templates.drop_recurring_lines(clashing)
    assert out.count() == len(small[0]) and set(clashing.columns) <= set(out.columns)
    assert all(r.text == "" for r in out.where("doc_id is not null").collect() if {x[0]: x[1] for x in small[0]}[r.doc_id] is None)


def test_line_templates_longest_line_recurs(spark):
    passage = " ".join(f"licence{'abcdefghij'[k % 10]}" for k in range(60))
    rows = [(i, "\n".join([*(f"own{'abcdefghij'[i]} line{'abcdefghij'[k]} here" for k in range(4)), passage])) for i in range(8)]
    rows += [(20 + i, rows[0][1]) for i in range(8)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0].text and all(passage not in got[i].text and got[i].n_removed == 1 for i in (*range(1, 8), *range(20, 28)))
    few = spark.createDataFrame(rows[:4] + rows[8:], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in line_templates.drop_recurring_lines(few).collect()), "four texts, twelve rows"


def test_passages(spark, small, none, clashing):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(12)] + [(99, "too short"), (98, None)]
    rows = []
    for i in range(40):
        body = [word() for _ in range(rng.randrange(0, 80))]
        if i % 2:
            own = items[i % 12][1].upper().split()
            if i % 4 == 3:
                own[0] = word()
            body[len(body) // 2 : len(body) // 2] = own
        rows.append((i, "  ".join(body)))
    rows += [(100, None), (101, ""), (None, items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shingles = lambda t: [tuple(x) for x in zip(*[split_words((t or "").lower())[k:] for k in range(5)])]
    want = {}
    for d, t in rows:
        own = shingles(t)
        for i, it in items:
            s = shingles(it)
            c = Counter(s)
            for at in range(len(own) - len(s) + 1) if s else ():
                both = sum((Counter(own[at : at + len(s)]) & c).values())
                if 100 * both >= 80 * (2 * len(s) - both):
                    best = (both / (2 * len(s) - both), -at)
                    want[d, i] = max(want.get((d, i), (0, 0)), best)
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in decontaminate.find_passages(docs, bench).collect()}
    assert got == want and len(want) > 15
    assert decontaminate.find_passages(none, bench).count() == 0
    assert decontaminate.find_passages(small[1], spark.createDataFrame([], "item_id long, text string")).count() == 0
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.drop_contaminated(clashing, bench).count() == len(small[0])


def test_passages_with_repeated_phrases(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, rows = [], []
    for i in range(100):
        often, rest = word(), [word() for _ in range(40)]
        items.append((i, " ".join([often] * 9 + rest)))  # 45 shingles, the first of them five times
        rows.append((i, " ".join([word() for _ in range(5)] + [often] * 4 + rest)))  # without these five: 40 / 50
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_passages(docs, bench).collect()
    assert all(r.doc_id == r.item_id and r.similarity == 0.8 for r in got) and len(got) >= 97


def test_passages_longer_than_the_document(spark):
    rng = random.Random(13)
    item = [f"w{rng.randrange(10**6)}" for _ in range(54)]  # 50 shingles
    texts = {1: item[:44], 2: item[:43], 3: item[:30] + item[31:], 4: item[10:], 5: item[:6], 6: item}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"x{i}" for i in range(90)))], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.similarity, r.start_word, r.n_words) for r in decontaminate.find_passages(docs, bench).collect()}
    assert got == {1: (7, 0.8, 0, 44), 3: (7, 45 / 54, 0, 53), 4: (7, 0.8, 0, 44), 6: (7, 1.0, 0, 54)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 5}
    for sizes in ([9, 18, 50], [41], [8], [120]):
        s = decontaminate.stride_for(sizes, 80)
        for n in sizes:
            for m in range(1, n + 1):
                need = next((c for c in range(m + 1) if 100 * c >= 80 * (n + m - c)), None)
                assert need is None or m // s > m - need


def test_hamming_blocks_are_complete(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(20)]
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 26)))
    near = [(7, k, flip(x)) for k, x in enumerate(base * 5)]
    got = decontaminate.near_fingerprints(spark.createDataFrame(near, "n int, window long, fingerprint long"), spark.createDataFrame([(7, k, x) for k, x in enumerate(base)], "n int, item_id long, fingerprint long"))
    want = {(7, w, i) for _, w, x in near for i, y in enumerate(base) if (x ^ y).bit_count() <= decontaminate.RADIUS}
    assert set(rows_of(got)) == want


def test_bucket_lengths_are_optimal():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(20):
        hist = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(8)}
        sizes = sorted(hist)
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= k) - k) for k, n in hist.items())
        best = min(cost((*c, sizes[-1])) for r in range(3) for c in combinations(sizes[:-1], r))
        assert cost(packing.bucket_lengths(hist, 3)) == best
    assert packing.bucket_lengths({}, 3) == [] and packing.bucket_lengths({0: 5}, 3) == []


def test_packing(small, none, clashing):
    rows, docs = small
    got = packing.pack(docs, max_words=64, buckets=4, budget=256).collect()
    assert sum(r.n_words for r in got) == sum(len(split_words(r[1])) for r in rows)
    by = defaultdict(list)
    for r in got:
        if r.n_words:
            assert split_words(r.text) == split_words({x[0]: x[1] for x in rows}[r.doc_id])[r.start_word : r.start_word + r.n_words] or r.doc_id is None
            assert r.padding == r.bucket_words - r.n_words >= 0
            by[r.bucket, r.batch].append(r)
        else:
            assert r.bucket is None and r.batch is None
    for (bucket, batch), own in by.items():
        room = max(1, 256 // own[0].bucket_words)
        last = max(k for b, k in by if b == bucket)
        assert sorted(r.slot for r in own) == list(range(len(own))) and (len(own) == room or batch == last and len(own) < room)
    assert packing.pack(none).count() == 0 and packing.pack(clashing, keep_text=False).count() >= len(rows)


def test_secrets(spark, none, clashing, small):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"some words here é token = \"{hexes(40)}\" more. AKIA{hexes(16).upper()} end {hexes(30)}") for i in range(80)]
    rows += [(i + 100, f"plain words number {i} and 4929{i:012d} of 10.0.0.{i}") for i in range(80)]
    rows += [(900, None), (901, ""), (902, "PassWord:x token=token: abcdefgh secret:  ſecret api-key='abc_def.ghi' apiKey=\"zzzzzz\""), (903, f"the Password is Zx9{hexes(24).upper()}q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = secret_scan.train(docs)
    got = {r.doc_id: r for r in secret_scan.scan(docs, field).collect()}
    for d, t in rows:
        t = t or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert set(text.split(",")) - {""} <= set(got[d].spans.split(","))
    assert all(got[i + 100].n_model == 0 for i in range(80))
    assert secret_scan.scan(none, field).count() == 0 and secret_scan.scan(clashing, secret_scan.train(none)).count() == len(small[0])


def test_viterbi_is_the_best_tagging():
    from itertools import product

    rng = random.Random(6)
    for _ in range(20):
        names = [f"f{i}" for i in range(5)]
        field = secret_scan.Field({f: tuple(rng.uniform(-2, 2) for _ in range(3)) for f in names}, tuple(tuple(rng.uniform(-2, 2) for _ in range(3)) for _ in range(3)))
        chain = secret_scan.Chain([(i, i + 1) for i in range(5)], [rng.sample(names, 2) for _ in range(5)])
        score = lambda tags: sum(field.emit[f][t] for own, t in zip(chain.features, tags) for f in own) + sum(field.step[a][b] for a, b in zip((0, *tags), (*tags, 0)))
        assert score(field.decode(chain)) == pytest.approx(max(score(t) for t in product(range(3), repeat=5)))


def test_surrogates(spark, none, clashing, small):
    rows = [
        (1, "Mail Ana.Lopez7@mail.example.com, again ana.lopez7@MAIL.example.com; call +1 (988) 555-2485 or +1 988 555 2485."),
        (2, "Card 4111 1111 1111 1111 = 4111111111111111 from 42.144.35.254. Mrs. Jane Miller and Mr Miller; Госпожа Анна Иванова"),
        (3, None), (4, ""), (5, "nothing private here"), (1, "Mr Miller"),
        *[(100 + i, f"user{i}@a.example.org and {10 + i % 90}.20.30.{i % 250}") for i in range(300)],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = surrogates.replace_private(docs, "key one").collect()
    text = {r.doc_id: r.text for r in got if r.text != rows[5][1]}
    mails = re.findall(r"[\w.]+@[\w.]+", text[1])
    assert len({m.lower() for m in mails[:2]}) == 1 and not re.search("lopez", text[1], re.I)
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[\d ()-]+\d", text[1])]
    assert len(digits) == 2 and digits[0] == digits[1] != "19885552485"
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"(?:\d{4} ?){4}", text[2])]
    luhn = lambda x: sum((d * 2 - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(x)))) % 10 == 0
    assert cards[0] == cards[1] != "4111111111111111" and luhn(cards[0]) and cards[0][0] == "4"
    names = re.findall(r"Mrs\. (\w+) (\w+) and Mr (\w+)", text[2])[0]
    assert names[0].endswith("a") and names[1] == names[2] != "Miller"
    assert re.search(r"Госпожа [А-Яа-я]+а [А-Яа-я]+", text[2]) and "Иванова" not in text[2]
    assert text[3] is None and text[4] == "" and text[5] == rows[4][1]
    drawn = [re.findall(r"\S+@\S+", text[100 + i])[0] for i in range(300)]
    assert len(set(drawn)) == 300 and not set(drawn) & {f"user{i}@a.example.org" for i in range(300)}
    again = {(r.doc_id, r.text) for r in surrogates.replace_private(docs, "key two").collect()}
    assert again != {(r.doc_id, r.text) for r in got}
    assert surrogates.replace_private(none, "k").count() == 0 and surrogates.replace_private(clashing, "k").count() == len(small[0])


def test_surrogates_grow_until_distinct(spark, monkeypatch):
    names = [("given-m-greek", f"n{i}") for i in range(70_000)]  # 16 ** 4 of four syllables
    parts = names + [("phone", f"1{i:02d}") for i in range(60)] + [("email", f"{c}@{d}.com") for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]
    got = rows_of(surrogates.surrogate_table(spark.createDataFrame(parts, "kind string, normal string"), "k"))
    assert {(k, n) for k, n, _ in got} == set(parts) and len({(k, s) for k, _, s in got}) == len(got) == len(parts)
    assert not {(k, s) for k, _, s in got} & set(parts)
    dressed = surrogates._dressed(F.lit("+1 22-33"), F.lit("phone"), F.array(F.lit("1234567")))
    assert spark.range(1).select(dressed).first()[0] == "+1 23-4567"
    monkeypatch.setattr(surrogates, "ROUNDS", 3)
    with pytest.raises(RuntimeError, match="card"):
        surrogates.surrogate_table(spark.createDataFrame([("card", "12"), ("card", "13"), ("card", "14")], "kind string, normal string"), "k")


def test_surrogate_table_has_no_collisions(spark):
    parts = spark.createDataFrame([("phone", f"1{i:02d}") for i in range(60)] + [("family-latin", f"n{i}") for i in range(3000)], "kind string, normal string")
    got = rows_of(surrogates.surrogate_table(parts, "k"))
    assert len(got) == 3060
    for kind in ("family-latin",):
        drawn = [s for k, _, s in got if k == kind]
        assert len(set(drawn)) == len(drawn)
