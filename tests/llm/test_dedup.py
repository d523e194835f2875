import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash_dedup
from corvane.llm.simhash_dedup import as_hex, finer_pools, links, near_groups, pools, set_prints, without_similar
from corvane.operators.components import connected_components


def _print(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_groups_match_brute_force(docs):
    rows = near_groups(docs).select("doc_id", as_hex().alias("f"), "component_id").collect()
    table = docs.select("doc_id", "text").collect()
    prints = [_print(r.text) for r in table]
    roots = _components(prints)
    least = {}
    for r, c in zip(table, roots, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), f"{p:016x}", str(least.get(c))) for r, p, c in zip(table, prints, roots, strict=True))
    assert sorted((str(r.doc_id), r.f, str(r.component_id)) for r in rows) == expected


def test_every_link_is_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(25):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            prints.add(int(b) ^ sum(1 << int(k) for k in bits))
    values = sorted(prints)
    roots = _components(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for chunk in (4, 1024):
        edges = links(df, chunk=chunk).union(df.select("fp", "fp"))
        got = {r.node: r.component for r in connected_components(edges).collect()}
        groups = {}
        for v, c in zip(signed, roots, strict=True):
            groups.setdefault(c, set()).add(v)
        for members in groups.values():
            assert {got[m] for m in members} == {min(members)}


def test_empty_table(empty_docs):
    assert near_groups(empty_docs).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(edges)
    assert got.count() == n and got.agg(F.max("component")).first()[0] == 0


def _shingles(text, k=5):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _first_kept(rows):
    """Greedy choice by brute force: in order of doc_id a row stays unless it is similar to one that stayed."""
    kept = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        if all(_jaccard(_shingles(t), _shingles(k)) < 0.8 for _, k in kept):
            kept.append((d, t))
    return kept


def _edited(rng, words, n):
    out = words[:]
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_similar_rows_go_and_others_stay(spark, docs, empty_docs):
    rng = random.Random(4)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(base)))
        for n in (0, 1, 2, 3, len(base) // 60, len(base) // 40, len(base) // 30):
            rows.append((len(rows), " ".join(_edited(rng, base, n))))
    rows += [(5000 + i, t) for i, t in enumerate(["", " ", None, "a b", "A B", "a b c d e", "a b c d e f"])] + [rows[3], (3, "another text under the id of row three, long enough"), (None, rows[8][1]), (None, "a row without an id, all of its own words here")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("key", F.lit("clash")).repartition(5)
    out = without_similar(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    expected = _first_kept(rows)
    assert len(got) == len(set(got))
    lost = {d for d, _ in expected} ^ {d for d, _ in got}
    assert len(lost) <= 1, lost  # the radius may lose one pair in a thousand at 0.8
    assert without_similar(empty_docs).count() == 0
    small = without_similar(docs)
    assert small.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in small.collect()}
    assert kept <= {(r.doc_id, r.text) for r in docs.collect()}
    assert {d for d, _ in kept} == {d for d, _ in _first_kept([(r.doc_id, r.text) for r in docs.collect()])}


def test_large_pools_take_few_rounds(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(_edited(rng, base, 2))) for i in range(500)] + [(1000 + i, " ".join(_edited(rng, base, 9))) for i in range(40)]
    got = {r.doc_id for r in without_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d for d, _ in _first_kept(rows)}


def test_pools_hold_similar_sets(spark):
    rng = random.Random(7)
    rows = []
    for g in range(300):
        n = rng.randint(40, 300)
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(_edited(rng, base, max(1, n // 48))))]
    prints = set_prints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.pool for r in pools(prints).join(prints.select("node", "doc_id"), "node").collect()}
    close = [g for g in range(300) if _jaccard(_shingles(rows[2 * g][1]), _shingles(rows[2 * g + 1][1])) >= 0.8]
    missed = [g for g in close if 2 * g not in found or found[2 * g] != found.get(2 * g + 1)]
    assert len(close) > 100 and len(missed) <= 1


def test_pages_of_one_template_take_few_rounds(spark, monkeypatch):
    """Rows that share about 75 % are near but not similar: they are parted, not compared round by round."""
    rng = random.Random(8)
    frame = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(3000):
        cut = rng.randrange(1, 4)
        own = [f"p{i}x{k}" for k in range(45)]
        rows.append((i, " ".join(frame[:250] + own + frame[250 + cut :])))
    rows += [(4000 + k, " ".join(_edited(rng, rows[7 * k][1].split(), 2))) for k in range(60)]
    assert 0.7 < _jaccard(_shingles(rows[0][1]), _shingles(rows[1][1])) < 0.8
    turns = []
    whole = simhash_dedup.new_path
    monkeypatch.setattr(simhash_dedup, "new_path", lambda spark, label: (turns.append(label), whole(spark, label))[1])
    got = {r.doc_id for r in without_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i for i in range(3000)}
    assert turns.count("pool-heads") <= simhash_dedup.WIDE_ROUNDS + 2


def test_finer_pools_lose_no_similar_pair(spark):
    rng = random.Random(9)
    sets = []
    for g in range(60):
        base = set(rng.sample(range(100_000), rng.randint(5, 80)))
        for _ in range(6):
            s = set(base)
            for x in rng.sample(sorted(base), rng.randint(0, max(1, len(base) // 6))):
                s.discard(x)
            s |= {rng.randrange(10**6) for _ in range(rng.randint(0, len(base) // 8))}
            sets.append(sorted(s or {1}))
    rows = [(1, i, (False, i, i), s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "pool long, node long, rank struct<unnamed: boolean, doc_id: long, key: long>, set array<long>")
    pool = {r.node: r.pool for r in finer_pools(df).collect()}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if _jaccard(set(sets[i]), set(sets[j])) >= 0.8]
    assert len(pairs) > 100 and all(i in pool and pool[i] == pool.get(j) for i, j in pairs)
    assert len(set(pool.values())) > 10


def test_finer_pools_make_rows_of_prefixes_alone(spark, monkeypatch):
    """A large group of near rows costs a row for each shingle of its prefixes, not for each of its shingles."""
    rng, made, whole = random.Random(10), {}, simhash_dedup.written
    frame = rng.sample(range(10**6), 100)
    sets = [sorted({*frame, *(10**7 + 50 * i + k for k in range(30))}) for i in range(400)] + [[], [1]]
    sets += [s[:-1] for s in sets[:40]]
    df = spark.createDataFrame([(1, i, (False, i, i), s) for i, s in enumerate(sets)], "pool long, node long, rank struct<unnamed: boolean, doc_id: long, key: long>, set array<long>").repartition(4)
    monkeypatch.setattr(simhash_dedup, "written", lambda frame, label: made.setdefault(label, whole(frame, label)))
    pool = {r.node: r.pool for r in finer_pools(df).collect()}
    assert pool == {i: i % 402 for i in [*range(40), *range(402, 442)]}
    assert max(f.count() for f in made.values()) <= sum(len(s) - -(-4 * len(s) // 5) + 1 for s in sets) < sum(map(len, sets)) / 4
