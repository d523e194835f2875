import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.llm import quality_rules as Q
from corvane.llm.common import Scan, texts_of
from corvane.llm.quality_gam import FEATURES, LEAF, RIDGE, _batch_features, _split, _tree, classify, fit, train, usable_labels


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_match_brute_force(docs, labels):
    rows = Q.quality_rules(docs, labels.where("quality = 1"), carry=("text",)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = _base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.text
        failed = expected[0] < 10 or 100 * expected[4] > 20 * expected[0]
        assert r.base_failed == failed
        assert r.kept == (not failed and r.llr >= Q.THRESHOLD)


def _grams(text):
    import pyarrow as pa

    scan = Scan(*texts_of(pa.array([text or ""])))
    return Q._grams(scan, scan.words(), Q.N_BUCKETS)[0].astype(int).tolist()


def test_log_ratio_matches_brute_force(docs, labels):
    trusted = labels.where("quality = 1")
    good = {r.doc_id for r in trusted.collect()}
    raw, target = Counter(), Counter()
    table = docs.select("doc_id", "text").collect()
    for r in table:
        raw.update(_grams(r.text))
        if r.doc_id in good:
            target.update(_grams(r.text))
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + Q.N_BUCKETS)
    got = {(r.doc_id, r.text): r.llr for r in Q.quality_rules(docs, trusted, carry=("text",)).collect()}
    for r in table:
        g = _grams(r.text)
        expected = sum(math.log(share(target, b) / share(raw, b)) for b in g) / (len(g) + Q.NEUTRAL_GRAMS)
        assert math.isclose(got[(r.doc_id, r.text)], expected, abs_tol=1e-9)


def test_rules_on_empty_tables(docs, empty_docs, labels):
    assert Q.quality_rules(empty_docs, labels).count() == 0
    assert Q.quality_rules(docs, labels.where("false")).agg(F.max(F.abs("llr"))).first()[0] == 0


def test_classifier_holds_out_and_learns(spark):
    from corvane.llm.queries import op7_quality_gam

    sf = "/root/testdata/sf0.01"
    rows = op7_quality_gam(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_classifier_edges(docs, empty_docs, labels):
    assert classify(docs, labels).count() == docs.count()
    assert classify(empty_docs, labels).count() == 0
    assert classify(docs, labels.where("false")).agg(F.max("score"), F.min("score")).first() == (0.5, 0.5)
    shuffled = labels.withColumn("quality", F.lit(None).cast("int"))
    assert classify(docs, shuffled).count() == docs.count()


def test_fit_finds_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    assert np.mean((model.score(x) > 0.5) == y) > 0.95
    again = fit(x, y)
    assert np.array_equal(model.score(x), again.score(x))


def _features(text):
    """The features from their names, letter by letter."""
    text = text or ""
    raw, words, lines = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    n, size = max(len(words), 1), max(len(raw), 1)
    n_words, chars, _, dup, rep = _base(text)
    among = lambda s: sum(c in s for c in text)
    symbols, letters = "#*$%&|<>@=+~^_{}[]\\/", sum(c.isascii() and c.isalpha() for c in text)
    odd = sum(any(c in symbols + "0123456789!?" for c in w) for w in words)
    return [
        math.log1p(n_words), chars / n, among(symbols) / size, sum(c.isascii() and c.isupper() for c in text) / max(letters, 1), among("0123456789") / size, among("!?") / size, among(".,;:") / n, dup / len(lines), rep / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n, sum(len(w.encode()) <= 1 for w in words) / n, n_words / len(lines), sum(b >= 128 for b in raw) / size, odd / n,
    ]


def test_features_match_brute_force(docs):
    texts = [r.text for r in docs.select("text").collect()] + ["A b! c? " * 50_000, "x" * 200_000]
    got = _batch_features(pa.array(texts, pa.string()))
    assert got.shape[1] == len(FEATURES)
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, _features(t), atol=1e-9), t and t[:80]


def test_splits_and_trees_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        g, h = rng.normal(size=9), rng.random(9) * 3
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + RIDGE)
        gains = {c: value(0, c) + value(c, 9) - value(0, 9) for c in range(1, 9) if h[:c].sum() >= LEAF and h[c:].sum() >= LEAF}
        gain, at = _split(g, h)
        assert math.isclose(gain, max([0.0, *gains.values()]), abs_tol=1e-9) and (gain <= 0 or math.isclose(gains[at], gain))
        tree = _tree(g, h)
        cuts = [0, *(i for i in range(1, 9) if tree[i] != tree[i - 1]), 9]
        assert len(cuts) <= 4 and all(math.isclose(tree[a], g[a:b].sum() / (h[a:b].sum() + RIDGE)) for a, b in zip(cuts, cuts[1:], strict=False))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(FEATURES)))
    y = (x[:, 2] + x[:, 4] * x[:, 5] > 0.9).astype(float)
    model = fit(x, y)
    for row in x[:50]:
        at = lambda edges, v: sum(e <= v for e in edges)
        total = model.intercept + sum(t[at(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True)) + sum(t[at(model.coarse[i], row[i]), at(model.coarse[j], row[j])] for i, j, t in model.pairs)
        assert math.isclose(model.score(row[None])[0], 1 / (1 + math.exp(-total)), abs_tol=1e-12)


def test_repeated_ids_are_learnt_once(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = docs.join(labels, "doc_id").select(*docs.columns).limit(1)
    many = docs.union(labelled.withColumn("doc_id", F.col("doc_id")).join(spark.range(500), how="cross").select(*docs.columns))
    assert np.array_equal(train(many, usable_labels(labels)).tables[0], train(docs, usable_labels(labels)).tables[0])
    ghosts = labels.select((F.col("doc_id") + 10**6).alias("doc_id"), "quality")
    few = train(docs, usable_labels(labels.select("doc_id", "quality").union(ghosts)), 60)
    assert few.intercept == train(docs, usable_labels(labels), 60).intercept


def test_counts_beyond_the_broadcast_bound(docs, labels):
    trusted = labels.where("quality = 1")
    small, large = Q.bucket_counts(docs, trusted), Q.bucket_counts(docs, trusted, few=0)
    assert all(np.array_equal(a, b) for a, b in zip(small, large, strict=True))
