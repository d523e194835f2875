"""Surfaces, trajectories, the shared-counter stream, workbooks, METEOR, patches, contours, refills and composed records."""

import itertools
import math
import random
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.metrics import sentence_meteor, word_alignment
from corvane.functions.stems import measure, stem
from corvane.operators import boxes as B
from corvane.operators import contours as Z
from corvane.operators import conversation as C
from corvane.operators import patches as P
from corvane.operators import sampling as S
from corvane.operators import surfaces as U
from corvane.plans import registry
from corvane.plans import volumes as V
from corvane.session import load
from corvane.sources import workbooks as W
from corvane.streaming import tracks as T
from corvane.streaming import trajectories as J

SF = "/root/testdata/sf0.001"


# Surfaces


def test_surface_areas_follow_from_the_geometry():
    a = U.surface_areas((1.0, 1.0, 1.0))
    assert a[0] == a[255] == 0
    assert a[1] == pytest.approx(math.sqrt(3) / 8)  # one corner cut off: an equilateral triangle
    assert a[0b11] == pytest.approx(math.sqrt(0.5))  # two cells along an edge: a slanted rectangle
    assert a[0b1111] == pytest.approx(1) and a[0b10000001] == pytest.approx(2 * a[1])
    turned = U.surface_areas((2.0, 1.0, 1.0))
    assert turned[0b1111] == pytest.approx(1) and turned[0b110011] == pytest.approx(2)
    # turning or mirroring the cube leaves the area as it is, but for how a bent polygon is parted into triangles
    for code in range(256):
        flipped = sum(1 << (7 - k) for k in range(8) if code >> k & 1)
        assert a[flipped] == pytest.approx(a[code], rel=0.35)


def test_distance_transform_is_exact():
    rng = np.random.default_rng(0)
    for shape, p in itertools.product(((5, 7, 9), (1, 1, 1), (12, 3, 20), (1, 30, 1)), (0.0, 0.03, 0.4)):
        grid, spacing = rng.random(shape) < p, (0.7, 1.3, 2.0)
        points, places = np.argwhere(grid) * spacing, np.argwhere(np.ones(shape, bool)) * spacing
        want = np.sqrt(((places[:, None] - points[None]) ** 2).sum(-1)).min(1) if len(points) else np.full(len(places), np.inf)
        assert np.allclose(U.distance_transform(grid, spacing).ravel(), want)


def _codes(mask):
    padded = np.pad(mask.astype(int), 1)
    out = np.zeros([n + 1 for n in mask.shape], int)
    for k, (i, j, l) in enumerate(itertools.product((0, 1), repeat=3)):
        out += padded[i : i + out.shape[0], j : j + out.shape[1], l : l + out.shape[2]] << k
    return out


def _plain_scores(truth, found, spacing, tolerance):
    """From whole arrays, every surface corner against every other."""
    areas = np.array(U.surface_areas(spacing))
    sides = []
    for m in (truth, found):
        code = _codes(m)
        at = np.argwhere((code > 0) & (code < 255))
        sides.append((at * np.array(spacing), areas[code[tuple(at.T)]]))
    ways = []
    for (p, a), (q, _) in (sides, sides[::-1]):
        d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min(1) if len(p) and len(q) else np.full(len(p), np.inf)
        order = np.lexsort((a, d))
        ways.append((d[order], a[order]))
    far = [d[min(np.searchsorted(np.cumsum(a) / a.sum(), 0.95), len(d) - 1)] if len(d) else np.inf for d, a in ways]
    dice = sum(a[d <= tolerance].sum() for d, a in ways) / sum(a.sum() for _, a in ways)
    return dice, max(far), *(a[d <= tolerance].sum() / a.sum() if len(a) else np.nan for d, a in ways)


def test_surface_scores_match_whole_arrays(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for case in range(12):
        shape = tuple(rng.integers(1, 9, 3))
        truth, found = (rng.random(shape) < p for p in (0.3 + 0.05 * (case % 9), 0.5))
        if case in (3, 7):
            found = found & False
        if case == 4:
            found = truth
        if not (truth | found).any():
            continue
        rows += [(case, int(z) - 4, int(y), int(x) + 100, bool(truth[z, y, x]), bool(found[z, y, x])) for z, y, x in np.ndindex(shape)]
        want[case] = _plain_scores(truth, found, (1.0, 2.0, 0.5), 1.0)
    rows += [(99, 0, 0, 0, False, None), rows[0], (rows[0][0], *rows[0][1:4], None, None)]  # no set cell; a repeat; a mark that is null
    table = spark.createDataFrame(rows, "case int, z int, y int, x int, truth boolean, found boolean").repartition(3)
    got = {r.case: r[1:] for r in U.surface_scores(table, ["case"], ["z", "y", "x"], "truth", "found", (1.0, 2.0, 0.5), 1.0).collect()}
    assert set(got) == set(want)
    for case, row in got.items():
        assert np.allclose(row, want[case], equal_nan=True), case
    assert U.surface_scores(table.where("false"), ["case"], ["z", "y", "x"], "truth", "found", (1.0, 2.0, 0.5), 1.0).collect() == []


# Trajectories


def _largest(score):
    """The one-to-one pairs of the largest total score, by exhaustive search over the sets of columns taken."""
    lefts, best = sorted({a for a, _ in score}), {frozenset(): (0.0, ())}
    for a in lefts:
        grown = dict(best)
        for taken, (total, pairs) in best.items():
            for (x, b), s in score.items():
                if x == a and b not in taken:
                    new = (total + s, (*pairs, (a, b)))
                    if taken | {b} not in grown or new[0] > grown[taken | {b}][0] + 1e-12:
                        grown[taken | {b}] = new
        best = grown
    return max(best.values(), key=lambda v: v[0])


def test_trajectories_match_plain_computation(spark):
    pairs, truths, tracks = (df.toPandas() for df in V.observed(spark, SF))
    got = registry.queries()["q136_trajectories"](spark, SF).toPandas().set_index("seq")
    assert len(got) == truths["seq"].nunique()
    for seq, row in got.iterrows():
        p, gt, tr = (df[df["seq"] == seq] for df in (pairs, truths, tracks))
        n_gt, n_tr, a, b = len(gt), len(tr), Counter(gt["truth"]), Counter(tr["track"])
        frames = Counter(map(tuple, p[p["similarity"] >= 0.5][["truth", "track"]].values.tolist()))
        idtp = _largest(frames)[0]
        assert (row.idtp, row.idfn, row.idfp) == (idtp, n_gt - idtp, n_tr - idtp)
        assert row.idf1 == pytest.approx(idtp / (idtp + 0.5 * (n_gt - idtp) + 0.5 * (n_tr - idtp)), abs=1e-6)
        whole = defaultdict(float)
        for _, f in p.groupby("frame"):
            by_gt, by_tr = f.groupby("truth")["similarity"].sum(), f.groupby("track")["similarity"].sum()
            for r in f.itertuples():
                whole[r.truth, r.track] += r.similarity / (by_gt[r.truth] + by_tr[r.track] - r.similarity)
        align = {k: v / (a[k[0]] + b[k[1]] - v) for k, v in whole.items()}
        matched = []
        for _, f in p.groupby("frame"):
            sim = {(r.truth, r.track): r.similarity for r in f.itertuples()}
            matched += [(*k, sim[k]) for k in _largest({k: align[k] * s for k, s in sim.items()})[1]]
        scores = defaultdict(list)
        for alpha in J.ALPHAS:
            hit = [m for m in matched if m[2] >= alpha - 1e-15]
            tp, count = len(hit), Counter(m[:2] for m in hit)
            deta = tp / max(1, n_gt + n_tr - tp)
            assa = sum(c * c / (a[g] + b[t] - c) for (g, t), c in count.items()) / max(1, tp)
            scores["hota"].append(math.sqrt(deta * assa))
            scores["deta"].append(deta)
            scores["assa"].append(assa)
            scores["assre"].append(sum(c * c / a[g] for (g, _), c in count.items()) / max(1, tp))
            scores["asspr"].append(sum(c * c / b[t] for (_, t), c in count.items()) / max(1, tp))
            scores["loca"].append(max(1e-10, sum(m[2] for m in hit)) / max(1e-10, tp))
        for name, values in scores.items():
            assert row[name] == pytest.approx(np.mean(values), abs=1e-6), (seq, name)


def test_best_pairs_are_the_best(spark):
    rng, rows = random.Random(4), []
    for g in range(60):
        for a, b in itertools.product(range(rng.randrange(1, 5)), range(rng.randrange(1, 6))):
            if rng.random() < 0.6:
                rows.append((g, a, 10 + b, rng.random() if rng.random() < 0.9 else 0.0))
    got = defaultdict(float)
    seen = set()
    for r in B.best_pairs(spark.createDataFrame(rows, "g int, a long, b long, s double"), ["g"], "a", "b", "s").collect():
        assert (r.g, "a", r.a) not in seen and (r.g, "b", r.b) not in seen
        seen |= {(r.g, "a", r.a), (r.g, "b", r.b)}
        got[r.g] += r.s
    for g in range(60):
        assert got[g] == pytest.approx(_largest({(a, b): s for h, a, b, s in rows if h == g})[0])


def test_a_perfect_tracker_scores_one(spark):
    rows = [(s, f, k) for s in ("a", "b") for f in range(5) for k in range(3)]
    truths = spark.createDataFrame(rows, "seq string, frame long, truth long")
    tracks = truths.withColumn("track", F.col("truth") + 100).drop("truth")
    pairs = truths.withColumn("track", F.col("truth") + 100).withColumn("similarity", F.lit(1.0))
    for row in J.alignment(pairs, truths, tracks).join(J.identity(pairs, truths, tracks), "seq").collect():
        assert row.hota == row.assa == row.loca == row.idf1 == 1
    none = pairs.where("seq = 'a'")
    left = {r.seq: (r.hota, r.loca) for r in J.alignment(none, truths, tracks).collect()}
    assert left == {"a": (1.0, 1.0), "b": (0.0, 1.0)}


@pytest.mark.parametrize(("files", "at_once"), [(1, 1), (5, 1), (6, 3)])
def test_the_stream_gives_what_the_batch_gives(spark, files, at_once):
    """However the stream is cut, and in whatever order its files come."""
    from corvane.plans.state import _run_out

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, V.ROCKS)
    try:
        got = _run_out(T.stream_sequences(V.sequence_stream(spark, SF, files, at_once), "seq", "frame", "slot", "score", "ts", tolerance=3), "append").collect()
    finally:
        spark.conf.set(name, before)
    want = registry.queries()["q127_shared_tracks"](spark, SF).select("seq", "frame", "slot", "track").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.track for r in got}) > 5


# Workbooks


@pytest.fixture()
def book(spark, tmp_path):
    W.register(spark)
    return f"{tmp_path}/folder/book.xlsx"


def test_a_workbook_comes_back_as_it_was(spark, book):
    texts = ["plain", " spaces  kept ", "<&>\"'", "a\tb\nc\rd", "_x0041_", "\x01\x1f", "é\U0001f600", "x" * 5000, None, "1", "true", "-0.5"]
    rows = [("first", t, i, i / 7, i % 2 == 0) for i, t in enumerate(texts)] + [("second", f"n{i}", -i, 1e300 * i, None) for i in range(500)]
    df = spark.createDataFrame(rows, "sheet string, name string, n long, x double, flag boolean")
    df.repartition(5).write.format(W.NAME).mode("append").save(book)
    back = spark.read.format(W.NAME).schema(df.schema).load(book)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.rdd.getNumPartitions() == 2
    keyed = spark.read.format(W.NAME).schema(df.schema).option("key", "name").option("sheet", "first").load(book)
    assert keyed.count() == len(texts) - 1
    assert spark.read.format(W.NAME).load(book).schema.simpleString() == "struct<sheet:string,name:string,n:string,x:string,flag:string>"
    with zipfile.ZipFile(book) as z:
        assert z.testzip() is None and "xl/worksheets/sheet2.xml" in z.namelist()


def test_workbooks_of_others_are_read(spark, book, tmp_path):
    """Shared strings, plain values, cells without references, gaps, errors."""
    main, link = W._MAIN, W._LINK
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="A &amp; B" sheetId="1" r:id="r7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{W._PACKAGE}/relationships"><Relationship Id="r7" Target="/xl/worksheets/other.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
        "xl/worksheets/other.xml": f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c r="AB1" t="str"><v>size</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>4.0</v></c></row><row r="3"><c r="AB3"><v>5</v></c></row><row r="4"><c r="A4" t="e"><v>#REF!</v></c></row></sheetData></worksheet>',
    }
    path = f"{tmp_path}/foreign.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    got = spark.read.format(W.NAME).schema("sheet string, name string, size int, missing string").load(path).collect()
    assert [tuple(r) for r in got] == [("A & B", "rich", 4, None), ("A & B", None, 5, None), ("A & B", None, None, None)]


def test_failed_writes_leave_nothing(spark, book, tmp_path):
    df = spark.createDataFrame([("s" * 40 + "1", 1), ("S" * 40 + "1", 2)], "sheet string, n long")
    with pytest.raises(Exception, match="sheets of one name"):
        df.write.format(W.NAME).mode("append").save(book)
    bad = spark.range(4).select(F.lit("s").alias("sheet"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string").alias("name"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format(W.NAME).mode("append").save(book)
    left = list((tmp_path / "folder").iterdir()) if (tmp_path / "folder").exists() else []
    assert left == []
    with pytest.raises(Exception, match="no map"):
        spark.range(1).select(F.create_map(F.lit("a"), "id").alias("m")).write.format(W.NAME).mode("append").save(book)
    spark.createDataFrame([], "sheet string, n long").write.format(W.NAME).mode("append").save(book)
    assert spark.read.format(W.NAME).load(book).collect() == []


# METEOR

# Words and stems that the published description of the algorithm gives as examples.
STEMS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


def test_stems_are_the_published_ones():
    for word, want in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stem(word) == want, word
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten", "orrery")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    assert stem("") == "" and stem("is") == "is"


def _figures(p, r, pairs):
    exact = sum(p[i] == r[j] for i, j in pairs)
    chunks = sum(k == 0 or pairs[k - 1] != (x[0] - 1, x[1] - 1) for k, x in enumerate(pairs))
    return -exact, exact - len(pairs), chunks, sum(a[0] < b[0] and a[1] > b[1] for a in pairs for b in pairs)


def test_alignment_is_the_best_of_all():
    rng = random.Random(1)
    words = ["run", "runs", "running", "cat", "cats", "the", "a", "dog"]
    for _ in range(400):
        p, r = ([rng.choice(words) for _ in range(rng.randrange(7))] for _ in range(2))
        options = [[None] + [j for j in range(len(r)) if stem(r[j]) == stem(w)] for w in p]
        every = ([(i, j) for i, j in enumerate(pick) if j is not None] for pick in itertools.product(*options) if len({j for j in pick if j is not None}) == sum(j is not None for j in pick))
        assert _figures(p, r, word_alignment(p, r)) == min(_figures(p, r, x) for x in every), (p, r)


def test_meteor_by_hand():
    assert sentence_meteor("the cat sat", "the cat sat") == pytest.approx(1 - 0.5 / 27)
    # the, cat and sat~sat match in two chunks of three; precision 3/4, recall 3/3
    mean = 0.75 * 1 / (0.9 * 0.75 + 0.1 * 1)
    assert sentence_meteor("sat the big cats", "the cat sat") == pytest.approx(mean * (1 - 0.5 * (3 / 3) ** 3))
    assert sentence_meteor("", "a") == sentence_meteor(None, None) == sentence_meteor("x", "y") == 0


def test_meteor_query(spark):
    """Changed items differ from their originals in whole words only, so the score follows from which words are equal."""
    from corvane.plans.metrics import _pairs

    got = {r.item_id: r.meteor for r in registry.queries()["q133_meteor"](spark, SF).collect()}
    rows = _pairs(spark, SF).collect()
    assert len(got) == len(rows)
    for row in rows:
        p, r = row.p.lower().split(), row.r.lower().split()
        same, roots = Counter(p) & Counter(r), Counter(map(stem, p)) & Counter(map(stem, r))
        hits = sum(roots.values())
        assert sum(same.values()) <= hits
        precision, recall = hits / len(p), hits / len(r)
        mean = precision * recall / (0.9 * precision + 0.1 * recall)
        assert mean * 0.5 - 1e-6 <= got[row.item_id] <= mean * (1 - 0.5 * (1 / hits) ** 3) + 1e-6


# Patches


def test_gaussian_weights(spark):
    tile = [4, 9, 16]
    places = list(itertools.product(*map(range, tile)))
    rows = spark.createDataFrame(places, "z int, y int, x int")
    got = {(r.z, r.y, r.x): r.w for r in rows.withColumn("w", P.gaussian_weight([F.col(a) for a in "zyx"], tile)).collect()}
    assert max(got.values()) == got[2, 4, 8] == 10.0
    for at in places:
        want = 10 * math.prod(math.exp(-0.5 * ((v - n // 2) / (n / 8)) ** 2) for v, n in zip(at, tile, strict=True))
        assert got[at] == pytest.approx(max(want, 2.0**-24))


def test_windows_cover_and_merge(spark):
    volumes = spark.createDataFrame([(1, 1, 5, 17), (2, 3, 6, 6), (3, 7, 20, 9)], "k int, nz int, ny int, nx int")
    cells = P.window_cells(volumes, ["nz", "ny", "nx"], [1, 6, 6], ["z", "y", "x"])
    made = P.merged(cells, ["k"], ["z", "y", "x"], F.lit(0.75), P.gaussian_weight([F.col("in_z"), F.col("in_y"), F.col("in_x")], [1, 6, 6])).collect()
    assert len(made) == 5 * 17 + 3 * 36 + 7 * 180
    assert all(r.value == pytest.approx(0.75) and r.set for r in made)


def test_centres_follow_the_weights(spark):
    """Many volumes with the same two cells, of weight 1 and 3: the second is drawn three times in four."""
    n = 4000
    plans = spark.range(n).select("id", F.lit(1).alias("nz"), F.lit(50).alias("ny"), F.lit(50).alias("nx"), *(F.lit(1).alias(f"p{a}") for a in "zyx"))
    cells = plans.select("id", F.explode(F.array(F.struct(F.lit(0).alias("z"), F.lit(10).alias("y"), F.lit(11).alias("x"), F.lit(1.0).alias("w")), F.struct(F.lit(0).alias("z"), F.lit(40).alias("y"), F.lit(41).alias("x"), F.lit(3.0).alias("w")))).alias("c")).select("id", "c.*")
    out = P.drawn_centres(plans, cells, "id", ["z", "y", "x"], ["nz", "ny", "nx"], ["pz", "py", "px"], 5, 0.5, F.col("w"))
    on = out.where("on_cell").select(F.avg((F.col("start_y") == F.col("start_y")).cast("double")), F.avg((F.col("start_x") > 30).cast("double")), F.count("*")).first()
    assert abs(on[1] - 0.75) < 0.04 and abs(on[2] / n - 0.5) < 0.04
    bare = P.drawn_centres(plans, cells.where("false"), "id", ["z", "y", "x"], ["nz", "ny", "nx"], ["pz", "py", "px"], 5, 1.0)
    assert bare.where("on_cell").count() == 0 and bare.agg(F.countDistinct("start_y")).first()[0] > 45


def test_plans_keep_their_budget(spark):
    rows = registry.queries()["q140_patch_plan"](spark, SF).join(load(spark, SF, "orders"), "o_orderkey").collect()
    for r in rows:
        flat = r.o_orderkey % 12 == 0
        tokens = r.patch_z // r.depth_patch * (r.patch_y // 16) * (r.patch_x // 16)
        assert r.patch_y % 16 == r.patch_x % 16 == 0 and tokens <= (49 if flat else 36) and r.depth_patch in (1, 2, 4, 8, 16)
        assert 0 <= r.start_y and 0 <= r.start_x and r.scale_xy > 0 and r.scale_z > 0


# Contours


def test_filled_cells_are_those_inside(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):
        n = rng.choice([0, 1, 2, 3, 4, 7])
        rows.append((k, [(float(rng.randrange(-4, 9)), rng.choice([float(rng.randrange(-3, 9)), rng.uniform(-3, 9)])) for _ in range(n)]))
    rows += [(40, [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]), (40, [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)])]  # a hole
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in rows], "k int, points array<struct<x: double, y: double>>")
    got = defaultdict(set)
    for r in Z.cells_of(df, ["k"], "points").collect():
        got[r.k].add((r.x, r.y))
    for k in range(41):
        want = set()
        for x, y in itertools.product(range(-6, 12), repeat=2):
            odd = 0
            for _, p in (r for r in rows if r[0] == k):
                for (a, b), (u, v) in zip(p, p[1:] + p[:1], strict=True):
                    odd += (b > y) != (v > y) and a + (y - b) * (u - a) / (v - b) <= x
            if odd % 2:
                want.add((x, y))
        assert got[k] == want, k
    assert len(got[40]) == 36 - 4


def test_consensus_and_slices(spark):
    square = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    rows = [(1, 1, 0, square(0, 4)), (1, 2, 0, square(2, 6)), (1, 3, 0, square(0, 0)), (2, 1, 0, square(0, 2))] + [(3, r, 0, square(0, 2)) for r in range(5)]
    df = spark.createDataFrame(rows, "lesion int, rater int, z int, points array<struct<x: double, y: double>>")
    got = {(r.lesion, r.x, r.y) for r in Z.consensus_of(df, ["lesion"], "rater", "z", "points").collect()}
    assert got == {(1, x, y) for x in (2, 3) for y in (2, 3)} | {(2, x, y) for x in (0, 1) for y in (0, 1)}  # lesion 3 has five raters
    slices = spark.createDataFrame([(1, 1.5, 4), (1, 1.5, 2), (1, 2.5, 9)], "scan int, z double, number int")
    assert sorted(tuple(r) for r in Z.slices_once(slices, "scan", "z", "number").collect()) == [(1, 1.5, 2), (1, 2.5, 9)]


# Refills and records


def test_refills(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    for passes, n in ((F.col("k") % 3 > 0, 40), (F.col("k") < 5, 60), (F.col("k") < 0, 10), (F.lit(None).cast("boolean"), 10), (F.lit(True), 30), (F.col("k") % 2 == 0, 100)):
        order = [r.k for r in S.shuffled(df, "k", 3).orderBy("rank").collect()]
        good = {r.k for r in df.where(passes).collect()}
        got = {r.place: (r.asked, r.k) for r in S.refilled(df, "k", 3, n, passes).collect()}
        spare = [k for k in order[n:] if k in good] + [k for k in order[:n] if k in good]
        want, used = {}, 0
        for place, k in enumerate(order[:n], 1):
            if k in good:
                want[place] = (k, k)
            elif spare:
                want[place] = (k, spare[used % len(spare)])
                used += 1
        assert got == want


def test_local_records(spark):
    rows = [
        (1, [("liver", "anatomy"), ("lung", "anatomy"), ("cyst", "anomaly"), ("mass", "anomaly"), ("spleen", "anatomy")], [("heart", "anatomy"), ("tumour", "anomaly")], ["CT"]),
        (2, [], [], ["MRI", "CT"]),
        (3, [], [("mass", "anomaly")], ["CT"]),
        (4, None, [("mass", "anomaly")], ["CT"]),
    ]
    kind = "array<struct<name: string, category: string>>"
    df = spark.createDataFrame(rows, f"k int, pos {kind}, neg {kind}, m array<string>").withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {kind})")) for c in ("pos", "neg")})
    made = {r.k: r.r for r in df.select("k", C.local_record(F.col("pos"), F.col("neg"), F.col("m"), 1, F.col("k"), 2, 1, p_modality=0.0, p_grounding=1.0, p_negative=1.0).alias("r")).collect()}
    assert [t.prompt for t in made[2].turns] == ["What is the modality of the image?"] and made[2].modality in ("MRI", "CT") and made[2].classes == []
    assert [t.response for t in made[3].turns] == ["No anomaly."] and [(c.name, c.positive) for c in made[3].classes] == [("mass", False)] == [(c.name, c.positive) for c in made[4].classes]
    one = made[1]
    assert len(one.turns) == 2 and one.turns[0].prompt.startswith("Are these present: ") and "heart: no" in one.turns[0].response and one.turns[1].response.count("cyst") == 1
    names = [(c.name, c.positive) for c in one.classes]
    assert len(names) == 6 and names[2] == ("heart", False) and names[5] == ("tumour", False) and {n for n, _ in names[3:5]} == {"cyst", "mass"}
    again = df.select("k", C.local_record(F.col("pos"), F.col("neg"), F.col("m"), 1, F.col("k"), p_modality=1.0, p_grounding=0.0).alias("r")).where("k = 1").first().r
    assert again.turns[0].response == "CT." and again.classes == [] and not again.negative_grounding


def test_full_cost_is_the_cheapest(spark):
    """Of each image, the total of the pairs against all one-to-one choices."""
    from corvane.plans.nesting import numbered_lines

    rows = numbered_lines(spark, SF).select(F.col("l_orderkey").alias("image"), "rn", F.col("l_returnflag").alias("cls"), F.least(F.col("l_extendedprice") / 100000, F.lit(0.99)).alias("score"), *(c.alias(n) for n, c in zip(B.CORNERS, V._shares(), strict=True))).toPandas()
    got = {r.image: (r.n, r.cost) for r in registry.queries()["q144_full_match_cost"](spark, SF).collect()}

    def cost(q, t):
        p = q.score
        hit, miss = 0.25 * (1 - p) ** 2 * -math.log(p + 1e-8), 0.75 * p**2 * -math.log(1 - p + 1e-8)
        centred = lambda b: ((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1)
        l1 = sum(abs(x - y) for x, y in zip(centred(q), centred(t), strict=True))
        area = lambda b: (b.x2 - b.x1) * (b.y2 - b.y1)
        shared = max(min(q.x2, t.x2) - max(q.x1, t.x1), 0) * max(min(q.y2, t.y2) - max(q.y1, t.y1), 0)
        union = area(q) + area(t) - shared
        hull = (max(q.x2, t.x2) - min(q.x1, t.x1)) * (max(q.y2, t.y2) - min(q.y1, t.y1))
        return 2 * (hit - miss) + 5 * l1 - 2 * (shared / (union + 1e-6) - (hull - union) / (hull + 1e-6))

    n = 0
    for image, g in rows.groupby("image"):
        truths, queries = list(g[g.cls == "A"].itertuples()), list(g[g.cls != "A"].itertuples())
        if not truths or not queries:
            continue
        few, many = sorted((truths, queries), key=len)
        if math.perm(len(many), len(few)) > 5000:
            continue
        best = min(sum(cost(b, a) if few is truths else cost(a, b) for a, b in zip(few, pick, strict=True)) for pick in itertools.permutations(many, len(few)))
        assert got[image][0] == len(few) and got[image][1] == pytest.approx(best, abs=1e-4)
        n += 1
    assert n > 200


def test_components_in_groups(spark):
    from corvane.operators.components import components_in_groups

    rng, rows, want = random.Random(6), [], {}
    for g in range(50):
        nodes = list(range(100 * g, 100 * g + 30))
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(1, 40))]
        label = {n: n for e in edges for n in e}
        for _ in nodes:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        want |= {(g, n): c for n, c in label.items()}
        rows += [(g, a, b) for a, b in edges]
    df = spark.createDataFrame([*rows, (7, None, 701), (7, 702, None)], "g int, src long, dst long")
    for large in (10, 100_000):
        got = {(r.g, r.node): r.component for r in components_in_groups(df, ["g"], large).collect()}
        assert got == want
    assert components_in_groups(df.where("false"), ["g"]).collect() == []


def test_groups_done_together_are_as_done_alone(spark, monkeypatch):
    """Suppression and consensus of many small groups at once, and of each group by itself."""
    rng, rows = random.Random(12), []
    for g in range(80):
        for k in range(rng.randrange(1, 9)):
            x, y = rng.uniform(0, 20), rng.uniform(0, 20)
            rows.append((g, k, rng.randrange(4), rng.randrange(6) / 6, x, y, x + rng.uniform(5, 25), y + rng.uniform(5, 25)))
    df = spark.createDataFrame(rows, "g int, k long, rater long, score double, x1 double, y1 double, x2 double, y2 double")

    def both():
        kept = B.suppressed(df, ["g"], "score", "k", 0.3, after=3)
        mean = B.consensus_boxes(df, ["g"], "rater")
        rounded = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        return sorted((r.g, r.k) for r in kept.collect()), sorted(map(rounded, mean.collect()))

    together = both()
    monkeypatch.setattr(B, "SMALL_GROUP", 0)
    assert both() == together and len(together[0]) > 100
