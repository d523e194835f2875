import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm.decontaminate import RADIUS, decontaminated, leaks


def _words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]


def _best(doc, item, df, k=5):
    """Best weighted Dice of all windows of the item's size, by brute force."""
    d, i = _words(doc), _words(item)
    if not i or len(d) < len(i):
        return 0.0
    k = min(k, len(i))
    grams = lambda w: [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]
    weight = lambda g: 1 / df.get(g, 1)
    own, best = grams(i), 0.0
    mass = sum(map(weight, own))
    for a in range(len(d) - len(i) + 1):
        win = grams(d[a : a + len(i)])
        shared = sum(min(win.count(g), own.count(g)) * weight(g) for g in set(own))
        best = max(best, 2 * shared / (mass + sum(map(weight, win))))
    return best


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(20, 45))) for i in range(25)] + [(90, "only three words"), (91, ""), (92, None), (93, "one")]
    docs = []
    for i, text in items[:25]:
        w = text.split()
        docs.append((len(docs), f"{say(30)} {text.upper()} {say(20)}"))
        edited = w[:]
        edited[len(w) // 2] = "changed"
        docs.append((len(docs), f"{say(5)} {' '.join(edited)}"))
        docs.append((len(docs), f"{say(25)} {' '.join(w[: len(w) // 2])} {say(30)}"))
        docs.append((len(docs), f"{say(8)} {' '.join(w[:10] + ['extra'] + w[10:])} {say(8)}"))
    docs += [(1000, None), (1001, ""), (1002, say(200)), (1003, "here are only three words more"), (None, items[0][1]), (0, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_leaks_match_brute_force(planted):
    docs, bench, rows, items = planted
    df = {}
    for _, t in items:
        w = _words(t)
        for g in {tuple(w[a : a + min(5, len(w))]) for a in range(len(w) - min(5, len(w)) + 1)} if w else ():
            df[g] = df.get(g, 0) + 1
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(docs, bench).collect()}
    expected = {(d, i): s for d, t in rows for i, x in items if (s := _best(t, x, df)) >= 0.8}
    assert set(got) == set(expected)
    for pair, s in got.items():
        assert s <= expected[pair] + 1e-6
    assert len(got) >= 60


def test_removal_keeps_the_rest(planted):
    docs, bench, _, _ = planted
    bad = {r.doc_id for r in leaks(docs, bench).collect()}
    extra = docs.withColumn("fp", F.lit("clash")).withColumn("h", F.lit(1))
    kept = decontaminated(extra, bench)
    assert kept.columns == extra.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_empty_sides(planted):
    docs, bench, _, _ = planted
    assert leaks(docs.where("false"), bench).count() == 0
    assert leaks(docs, bench.where("false")).count() == 0
    assert decontaminated(docs, bench.where("false")).count() == docs.count()


def _clamped_best(doc, item, df):
    """As ``_best``, but a text shorter than the item is one window."""
    d, i = _words(doc), _words(item)
    return _best(doc + " pad" * max(0, len(i) - len(d)), item, df) if len(d) >= len(i) else _dice(d, i, df)


def _dice(a, b, df, k=5):
    grams = lambda w: [tuple(w[x : x + k]) for x in range(len(w) - k + 1)]
    weight = lambda g: 1 / df.get(g, 1)
    own, win = grams(b), grams(a)
    shared = sum(min(win.count(g), own.count(g)) * weight(g) for g in set(own))
    return 2 * shared / (sum(map(weight, own)) + sum(map(weight, win)))


def _frequencies(items):
    df = {}
    for _, t in items:
        w = _words(t)
        for g in {tuple(w[a : a + 5]) for a in range(len(w) - 4)}:
            df[g] = df.get(g, 0) + 1
    return df


def test_clipped_shortened_and_reordered_passages_are_found(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, say(40)) for i in range(6)]
    docs = []
    for _, t in items:
        w = t.split()
        for text in (f"{say(30)} {' '.join(w[:-2])}", f"{' '.join(w[2:])} {say(30)}", " ".join(w[:20] + w[21:]), " ".join(w[3:]), f"{say(30)} {' '.join(w[20:] + w[:20])} {say(30)}"):
            docs.append((len(docs), text))
    df = _frequencies(items)
    expected = {(d, i): s for d, t in docs for i, x in items if (s := _clamped_best(t, x, df)) >= 0.8}
    got = {(r.doc_id, r.item_id): r for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(expected) and len(got) >= 30
    for pair, r in got.items():
        assert abs(r.similarity - expected[pair]) < 1e-6
        assert r.start_word >= 0 and r.start_word + r.n_words <= len(_words(docs[pair[0]][1]))


def test_edits_down_to_the_threshold_are_found(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    shared = say(12)
    items = [(i, f"{shared} {say(48)}") for i in range(6)] + [(i, say(60)) for i in range(6, 12)]
    docs = []
    for _, t in items:
        w = t.split()
        for cut in range(2, 14):
            docs.append((len(docs), f"{say(15)} {' '.join(w[: 60 - cut])} {say(40)}"))
            docs.append((len(docs), f"{say(40)} {' '.join(w[cut:])} {say(15)}"))
    df = _frequencies(items)
    expected = {(d, i): s for d, t in docs for i, x in items if (s := _best(t, x, df)) >= 0.8}
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(expected) and len(got) > 200
    assert all(abs(s - expected[p]) < 1e-6 for p, s in got.items())


def test_the_index_alone_finds_what_lies_within_its_radius(planted):
    """Of all leaks, the index finds those within the radius and no others; the join adds the rest."""
    docs, bench, _, _ = planted
    both = {(r.doc_id, r.item_id, r.similarity) for r in leaks(docs, bench).collect()}
    alone = {(r.doc_id, r.item_id, r.similarity): r.distance for r in leaks(docs, bench, complete=False).collect()}
    assert all(d <= RADIUS for d in alone.values())
    pairs, indexed = {p[:2] for p in both}, {p[:2] for p in alone}
    assert indexed <= pairs and 0.6 * len(pairs) < len(indexed) <= len(pairs)
    assert {p[:2] for p in both if p[2] > 0.97} <= indexed
