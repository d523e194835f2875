import functools
import random

import numpy as np
import pytest
from corvane.llm import hard_negatives as module
from corvane.llm.common import join_checked
from corvane.llm.hard_negatives import exact_scores, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, rank int"
EVERY = "vec_id % 100 = 0"


def plainly(rows, positives=5, negatives=10, low=30, high=90):
    """All rows scored against all anchors with Python's own integers."""
    use = {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        made = (lab, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        use[i] = min(use.get(i, made), made)
    out = []
    for a, (lab, va) in use.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, other) for i, (other, v) in use.items() if i != a)
        for ps, p, other in [s for s in scored if s[2] == lab][:positives]:
            near = [(-s, i) for s, i, o in scored if o != lab and low * -ps <= 100 * -s <= high * -ps][:negatives]
            out += [(a, p, k + 1, i, -ps, s) for k, (s, i) in enumerate(near)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(parts)


def some(n=900, seed=1, dim=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, [x + r.gauss(0, 0.7) for x in c], r.randrange(3)))
    rows += [(n + i, list(rows[7][1]), r.randrange(3)) for i in range(150)]  # ties
    odd = [(5000, None, 1), (5001, [1.0, None] + [0.0] * 6, 1), (5002, [float("nan")] * dim, 1), (5003, [float("inf")] + [1.0] * 7, 0), (5004, [1.0] * dim, None), (None, [1.0] * dim, 0)]
    odd += [(5100, [], 0), (5101, [1.0, 2.0], 0), (5200, [0.0] * dim, 1), (300, [2.0] * dim, 0), (5300, [9.0] * dim, 77)]
    return rows + odd


@pytest.mark.parametrize("small", [False, True])
def test_against_all_scores(spark, monkeypatch, small):
    if small:  # many blocks, tiles and groups, and joins that shuffle
        monkeypatch.setattr(module, "BLOCK_CELLS", 200)
        monkeypatch.setattr(module, "TILE", 64)
        monkeypatch.setattr(module, "GROUP", 3)
        monkeypatch.setattr(module, "join_checked", functools.partial(join_checked, limit=0))
    rows = some()
    got = found(hard_negatives(frame(spark, rows), EVERY))
    assert got == plainly(rows)
    assert len(got) > 100


def test_other_limits(spark):
    rows = some(seed=4)
    assert found(hard_negatives(frame(spark, rows), EVERY, positives=2, negatives=3, low=-50, high=120)) == plainly(rows, 2, 3, -50, 120)


def test_empty_tables(spark):
    assert found(hard_negatives(frame(spark, []), EVERY)) == []
    assert found(hard_negatives(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)]), EVERY)) == []
    assert found(hard_negatives(frame(spark, [(100, [1.0], 0), (2, [1.0], 1)]), EVERY)) == []


def test_scores_are_exact():
    r = np.random.default_rng(0)
    for top in (100, 1 << 30, 1 << 40):
        a, b = (r.integers(-top, top, (5, 6)) for _ in range(2))
        want = np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63), (1 << 63) - 1)
        assert (exact_scores(a, b) == want.astype(np.int64)).all()
    assert exact_scores(np.ones((2, 3), np.int64), np.ones((4, 2), np.int64)).tolist() == [[2] * 4] * 2
