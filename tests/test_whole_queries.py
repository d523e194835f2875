"""Whole queries that SQL can't express, against plain computations over the same tables."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from corvane.functions import metrics as M
from corvane.operators import boxes as B
from corvane.plans import registry
from corvane.plans.geometry import boxes

SF = "/root/testdata/sf0.001"
CORNERS = ["x1", "y1", "x2", "y2"]


@pytest.fixture(scope="module")
def rows(spark):
    return boxes(spark, SF).toPandas()


def _run(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return shared / (area(a) + area(b) - shared + 1e-6)


def _giou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - shared
    hull = (max(a[2], b[2]) - min(a[0], b[0])) * (max(a[3], b[3]) - min(a[1], b[1]))
    return shared / (union + 1e-6) - (hull - union) / (hull + 1e-6)


def test_suppression(spark, rows):
    kept = defaultdict(list)
    for (_, cls), g in rows.groupby(["image", "class"]):
        left = g.sort_values(["score", "rn"], ascending=[False, True]).to_dict("records")
        taken = []
        for r in left:
            if all(_iou([r[c] for c in CORNERS], [t[c] for c in CORNERS]) <= 0.3 for t in taken):
                taken.append(r)
        kept[cls] += [t["score"] for t in taken]
    got = _run(spark, "q50_nms").set_index("class")
    assert set(got.index) == set(kept)
    assert all(int(r.n) == len(kept[c]) and abs(r.score - sum(kept[c])) < 1e-4 for c, r in got.iterrows())


def test_assignment_is_the_cheapest(spark, rows):
    got = _run(spark, "q82_assignment").set_index("image")
    expected = {}
    for image, g in rows.groupby("image"):
        own, other = g[g["class"] == "A"][CORNERS].to_numpy(), g[g["class"] != "A"][CORNERS].to_numpy()
        if not len(own) or not len(other):
            continue
        cost = np.array([[round(1 - _giou(q, t), 9) for t in own] for q in other])
        cost = cost if len(other) <= len(own) else cost.T
        expected[image] = (cost.shape[0], float(min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(cost.shape[1]), cost.shape[0]))))
    assert set(got.index) == set(expected)
    assert all(int(r.n) == expected[i][0] and abs(r.cost - expected[i][1]) < 1e-5 for i, r in got.iterrows())


def test_consensus_boxes(spark, rows):
    found = defaultdict(list)
    for (_, cls), g in rows.groupby(["image", "class"]):
        b, raters = g[CORNERS].to_numpy(), g["rater"].tolist()
        threshold = 0.25
        while True:
            label = list(range(len(b)))
            for _ in range(len(b)):
                for i, j in itertools.product(range(len(b)), repeat=2):
                    if raters[i] != raters[j] and _iou(b[i], b[j]) >= threshold:
                        label[i] = label[j] = min(label[i], label[j])
            if threshold >= 1 or max(Counter(label).values()) <= len(set(raters)):
                break
            threshold = round(threshold + 0.05, 10)
        for c in set(label):
            members = b[[k == c for k in label]]
            found[cls].append((len(members), members[:, 2].mean()))
    got = _run(spark, "q83_consensus_boxes").set_index("class")
    for cls, r in got.iterrows():
        assert (int(r.n), int(r.boxes)) == (len(found[cls]), sum(n for n, _ in found[cls]))
        assert abs(r.x2 - np.mean([x for _, x in found[cls]])) < 1e-3


def _pairs():
    for r in pd.read_parquet(f"{SF}/benchmark.parquet").itertuples():
        w = r.text.split(" ")
        yield r.item_id, " ".join([x + "x" if i % 7 == 6 else x for i, x in enumerate(w) if i] + w[2:3]), r.text


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_bleu_and_rouge(spark):
    got = _run(spark, "q75_bleu4_rouge_l").set_index("item_id")
    for item, p, r in _pairs():
        p, r = p.split(), r.split()
        logs = 0
        for n in range(1, 5):
            grams = lambda w, n=n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            hit, total = sum((grams(p) & grams(r)).values()), max(len(p) - n + 1, 0)
            logs = logs + np.log(hit / total) if hit else -np.inf
        bleu = np.exp(logs / 4) * (1 if len(p) >= len(r) else np.exp(1 - len(r) / len(p)))
        assert abs(got.loc[item].bleu4 - bleu) < 1e-5 and abs(got.loc[item].rouge_l - 2 * _lcs(p, r) / (len(p) + len(r))) < 1e-5


def test_meteor(spark):
    got = _run(spark, "q133_meteor").set_index("item_id")
    for item, p, r in _pairs():
        assert abs(got.loc[item].meteor - M.sentence_meteor(p, r)) < 1e-5
    assert M.sentence_meteor("the cat sat", "the cat sat") == pytest.approx(1 - 0.5 / 27)
    assert M.sentence_meteor("cats walked", "a cat walks") == pytest.approx((1 * (2 / 3) / (0.9 + 0.1 * 2 / 3)) * (1 - 0.5 * (1 / 2) ** 3))
    assert M.sentence_meteor("a b", "b a") == pytest.approx(0.5) and M.sentence_meteor("", "a") == 0 == M.sentence_meteor("x", "a")


def test_slots_are_the_cheapest(spark, rows):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m, u = rng.integers(1, 6), rng.integers(0, 4), int(rng.integers(0, 3))
        cost, p = rng.random((n, m)), rng.random(n)
        got = B.slots(cost, 1 - p, p, u)
        u = min(max(n - m, 0), u)
        negatives = max(n - m - u, 0)
        if negatives == n:
            assert (got == B.NEGATIVE).all()
            continue
        price = lambda match: sum(cost[i, t] + 1 - p[i] if t >= 0 else p[i] if t == B.NEGATIVE else 0 for i, t in enumerate(match))
        choices = [c for c in itertools.product([*range(m), B.NEGATIVE, B.UNCERTAIN], repeat=int(n)) if max(Counter(x for x in c if x >= 0).values(), default=0) <= 1 and c.count(B.NEGATIVE) <= negatives and c.count(B.UNCERTAIN) <= u]
        if n <= m + negatives + u:
            assert price(got.tolist()) == pytest.approx(min(map(price, choices)))
    counts = _run(spark, "q134_slot_matches").set_index("outcome").n
    expected = Counter()
    for image, g in rows.groupby("image"):
        m, n = int((g["class"] == "A").sum()), int((g["class"] != "A").sum())
        if n:
            u = min(max(n - m, 0), image % 3)
            expected.update({"positive": min(n, m), "uncertain": u, "negative": n - min(n, m) - u})
    assert {k: int(v) for k, v in counts.items()} == {k: v for k, v in expected.items() if v}
