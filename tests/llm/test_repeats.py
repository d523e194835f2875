import functools
import random
import re

import pytest
from corvane.llm import phrase_repeats
from corvane.llm.common import join_checked
from corvane.llm.phrase_repeats import Passages, repeats_removed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def plainly(rows, window=50):
    """The operator's rows, every window compared with every other by its words."""
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    rank = lambda d: LAST if d is None else d
    least = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, LAST), rank(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < rank(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect())


def corpus(seed=7, n=120, window=50):
    """Texts that share passages of all lengths round the window, whole copies, near copies, and words said over and over."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passages = [[word() for _ in range(k)] for k in (window - 1, window, window + 1, 2 * window, 5 * window)]
    common = [word() for _ in range(window - 5)]
    rows = []
    for d in range(n):
        w = [word() for _ in range(r.randrange(3 * window))]
        for _ in range(r.randrange(3)):
            at, p = r.randrange(len(w) + 1), r.choice([*passages, common])
            cut = r.randrange(max(1, len(p) - window + 3))
            w[at:at] = p[cut:] if r.random() < 0.5 else p
        rows.append((d, r.choice([" ", "  ", "\n", " \t"]).join(w)))
    rows += [(n + i, rows[r.randrange(n)][1]) for i in range(40)]  # copies
    for i in range(40):  # near copies
        w = rows[r.randrange(n)][1].split()
        for _ in range(1 + len(w) // 60):
            if w:
                w[r.randrange(len(w))] = word()
        rows.append((2 * n + i, " ".join(w)))
    rows += [(1000 + i, " ".join(["same"] * k)) for i, k in enumerate((window - 1, window, window + 9, 40 * window))]
    rows += [(2000, " ".join(["a", "b"] * window)), (2001, " ".join(["b", "a"] * window)), (3, rows[3][1]), (3, rows[50][1]), (None, rows[5][1]), (None, rows[5][1] + " end"), (3000, None), (3001, "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "phrase", "shard", "part"), [(50, 8, 16_384, 4 << 20), (50, 8, 40, 4000), (12, 4, 25, 1500), (5, 5, 100, 3000)])
def test_against_every_window(spark, window, phrase, shard, part):
    rows = corpus(window=window)
    got = repeats_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window, phrase, shard, part)
    assert found(got) == plainly(rows, window)


def test_joins_that_shuffle(spark, monkeypatch):
    monkeypatch.setattr(phrase_repeats, "join_checked", functools.partial(join_checked, limit=0))
    rows = corpus(seed=3, n=60)
    assert found(repeats_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard=60, part_bytes=9000)) == plainly(rows)


def test_documents_with_edges(spark, docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(repeats_removed(docs)) == plainly(rows)
    assert repeats_removed(empty_docs).collect() == []


def test_long_texts(spark):
    r = random.Random(5)
    long = [f"v{r.randrange(10**6)}" for _ in range(200_000)]  # over a megabyte: a pass of its own
    rows = [(1, " ".join(long)), (2, "x y " + " ".join(long[100_000:])), (3, " ".join(long[:49])), (4, " ".join(long[70:121]))]
    assert found(repeats_removed(spark.createDataFrame(rows, "doc_id long, text string"), shard=2000)) == plainly(rows)


def test_a_crowd_of_copies_is_many_tasks(spark):
    """A third of all rows are copies of one text: their shard is dealt to many parts."""
    r = random.Random(11)
    text = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(120))
    hot = text()
    rows = [(i, text()) for i in range(400)] + [(1000 + i, hot) for i in range(200)]
    assert found(repeats_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), part_bytes=5000)) == plainly(rows)


def test_equal_windows_choose_equal_phrases():
    import numpy as np

    r = random.Random(2)
    core = " ".join(f"t{r.randrange(30)}" for _ in range(60))
    made = []
    for text in (core, "before that " + core + " after", core + " " + core):
        data = np.frombuffer(text.encode(), np.uint8)
        p = Passages(data, np.array([0, len(data)]), 50, 8)
        made.append({(int(h), int(c)) for h, c in zip(p.hashes(p.start, 50), p.chose - p.start, strict=True)})
    assert made[0] <= made[1] and made[0] <= made[2]
