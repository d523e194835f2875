"""Properties and micro fixtures of the operators, sources and keyed state."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import boxes as B
from corvane.operators import nesting as N
from corvane.operators import ranking as R
from corvane.operators import sampling as S
from corvane.sources import readers, writers
from corvane.streaming import tracks as T
from corvane.streaming import workers as K


def test_nested_lists(spark):
    df = spark.createDataFrame([("a", 1, "q1"), ("b", 2, "q2"), ("a", 3, "q3")], "img string, ord int, q string")
    got = {r.img: [x.q for x in r.vqa] for r in N.nested(df, ["img"], ["ord"], ["q"], "vqa").collect()}
    assert got == {"a": ["q1", "q3"], "b": ["q2"]}


def test_lookup_keeps_order_and_misses(spark):
    df = spark.createDataFrame([(1, ["x", "z", "x"]), (2, [])], "id int, keys array<string>")
    table = spark.createDataFrame([("x", "PA")], "k string, v string")
    got = {r.id: r.out for r in N.looked_up_in_order(df, "id", "keys", table, "k", "v", "out").collect()}
    assert got == {1: ["PA", None, "PA"], 2: []}


def test_strict_and_unique(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="no partner"):
        N.strict_join(df, df.where("k = 1"), ["k"])
    with pytest.raises(ValueError, match="unique"):
        N.unique_or_fail(df.union(df), ["k"])
    with pytest.raises(ValueError, match="outside"):
        N.histogram(spark.createDataFrame([(7,)], "c long"), "c", 3)


def test_histogram_and_means(spark):
    assert [r.n for r in N.histogram(spark.createDataFrame([(0,), (0,), (2,)], "c long"), "c", 3).orderBy("c").collect()] == [2, 0, 1]
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "a", 0.0), ("d", "b", 1.0)], "ds string, label string, v double")
    assert N.two_level_mean(df, ["ds"], ["label"], "v").first().v == 0.75


def test_holdout_properties(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r.k: r.split for r in S.holdout(df, "k", 1, n=100).collect()}
    assert sum(v == "validate" for v in one.values()) == 100
    assert one == {r.k: r.split for r in S.holdout(df.repartition(7), "k", 1, n=100).collect()}
    assert one != {r.k: r.split for r in S.holdout(df, "k", 2, n=100).collect()}
    assert S.holdout(df, "k", 1, share=0.9).where("split = 'train'").count() == 900


def test_mixture_shares_and_epochs(spark):
    spec = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "dataset string, weight double")
    rows = spark.range(60).select(F.when(F.col("id") < 40, "a").otherwise("b").alias("dataset"), F.col("id").alias("key"))
    got = S.mixture(spec, rows, 1000, 3).collect()
    share = sum(r.dataset == "a" for r in got) / 1000
    assert len(got) == 1000 and abs(share - 0.4) < 3 * (0.24 / 1000) ** 0.5
    for _, part in itertools.groupby(sorted(got, key=lambda r: (r.dataset, r.epoch)), key=lambda r: (r.dataset, r.epoch)):
        keys = [r.key for r in part]
        assert len(keys) == len(set(keys))


def test_positive_first_and_weights(spark):
    df = spark.createDataFrame([("s", True, i) for i in range(2)] + [("s", False, 10 + i) for i in range(5)], "g string, pos boolean, k int")
    got = S.positives_first(df, "g", "pos", "k", 1, 4, 0.5).collect()
    assert sum(r.pos for r in got) == 2 and len(got) == 3
    w = S.rebalanced(spark.range(10).withColumn("neg", F.col("id") < 8), "neg", 0.2)
    assert w.where("neg").first().weight == pytest.approx(0.0625)


def test_clip_frames(spark):
    assert spark.range(1).select(S.clip_frames(F.lit(7), F.lit(10), 2, 4).alias("f")).first().f == [7, 9, 9, 9]


def test_fallback_and_quantile(spark):
    df = spark.createDataFrame([("c", 0, 0.05), ("c", 1, 0.04)], "cls string, no int, s double")
    assert [r.no for r in R.passing_or_first(df, ["cls"], [F.col("no")], F.col("s") >= 0.1).collect()] == [0]
    x = spark.range(1, 11).select(F.lit("g").alias("g"), F.col("id").alias("x"))
    assert R.nearest_rank(x, ["g"], "x", 0.25).first().quantile == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=4, max_size=4), min_size=1, max_size=4))
def test_assignment_is_cheapest(rows):
    cost = np.array(rows, float)
    pick = B.assignment(cost)
    best = min(sum(cost[i, p[i]] for i in range(len(rows))) for p in itertools.permutations(range(4), len(rows)))
    assert len(set(pick.tolist())) == len(rows) and cost[np.arange(len(rows)), pick].sum() == best


def test_suppression_and_overlap(spark):
    df = spark.createDataFrame([("i", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("i", 2, 0.8, 1.0, 1.0, 10.0, 10.0), ("i", 3, 0.7, 20.0, 20.0, 30.0, 30.0)], "img string, no int, s double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.no for r in B.suppressed(df, ["img"], "s", "no", 0.5).collect()) == [1, 3]
    assert {(r.no, r.o_no) for r in B.overlapping(df, df, ["img"], 4.0).where("no < o_no").collect()} == {(1, 2)}
    clusters = B.raters_clusters(np.array([[0, 0, 4, 4], [0, 0, 4, 4.2], [9, 9, 12, 12]]), np.array([1, 2, 1]))
    assert clusters[0] == clusters[1] != clusters[2]


def test_track_lifecycle():
    state, ids = (T.UNBORN, 0, 0), []
    for score in (0.9, 0.1, 0.7, 0.1, 0.1, 0.9):
        state = T.advance(state, score, 0.6, 2)
        ids.append(state[0])
    assert ids == [0, 0, 0, 0, -1, 1]


def test_sequences_share_a_counter(spark):
    rows = [("v", f, s, v) for f, row in enumerate([(0.9, 0.1), (0.1, 0.9), (0.1, 0.1)]) for s, v in enumerate(row)]
    got = {(r.frame, r.slot): r.track for r in T.track_sequences(spark.createDataFrame(rows, "seq string, frame int, slot int, score double"), tolerance=2).collect()}
    assert got[(0, 0)] == 0 and got[(1, 1)] == 1 and got[(2, 0)] == -1


def test_registry_and_lottery(spark):
    beats = spark.sql("select * from values ('a', timestamp_ntz'2024-01-01 00:00:00'), ('b', timestamp_ntz'2024-01-01 00:01:00') t(w, at)")
    now = F.lit("2024-01-01 00:01:10").cast("timestamp_ntz")
    assert [r.w for r in K.registry(beats, "w", "at", now, 30).collect()] == ["b"]
    workers = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "w string, speed double")
    got = K.lottery(workers, "w", "speed", spark.range(2000), "id", 5).groupBy("w").count().collect()
    assert abs({r.w: r["count"] for r in got}["b"] / 2000 - 0.75) < 0.04


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": 3, "v": NaN}, {"q": "x", "v": 1.5}]')
    got = readers.json_array(spark, str(tmp_path / "a.json"), "q string, v double", nan=True).collect()
    assert [r.q for r in got] == ["3", "x"] and np.isnan(got[0].v)
    (tmp_path / "b.csv").write_text("id,plane\n008,\n009,PA\n")
    assert [tuple(r) for r in readers.table_csv(spark, str(tmp_path / "b.csv"), "id string, plane string", blank=("plane",)).collect()] == [("008", ""), ("009", "PA")]
    (tmp_path / "c.txt").write_text("im1|what|yes\nim2|who\n")
    assert [tuple(r) for r in readers.piped(spark, str(tmp_path / "c.txt"), {"image": 0, "q": 1, "a": 2}).collect()] == [("im1", "what", "yes"), ("im2", "who", None)]
    (tmp_path / "d.cfg").write_text("Group: NOR\nHeight: 1.8: m\n")
    assert readers.settings(spark, str(tmp_path / "d.cfg")).first().settings == {"Group": "NOR", "Height": "1.8: m"}
    gt = tmp_path / "seq1" / "gt"
    gt.mkdir(parents=True)
    (gt / "gt.txt").write_text("1,1,0,0,5,5,1,1\n3,1,0,0,5,5,1,1\n2,2,0,0,5,5,0,1\n2,3,0,0,5,5,1,9\n")
    truth = readers.mot_truth(spark, str(gt / "gt.txt"))
    assert truth.count() == 2 and truth.first().seq == "seq1"
    assert [r.frame for r in readers.frame_ranges(truth).orderBy("frame").collect()] == [1, 2, 3]


def test_inventory_and_registry(spark, tmp_path):
    for n in ("case_001_img.nii", "case_002_img.nii", "other.txt"):
        (tmp_path / n).write_text("x")
    rows = readers.inventory(spark, str(tmp_path), "*.nii", "case_", "_img.nii")
    assert sorted(r.key for r in rows.collect()) == ["001", "002"]
    sets = readers.Datasets()
    sets.register("a", lambda s: s.range(2), classes=3)
    sets.register("b", lambda s: s.range(3), classes=3)
    assert sets.together(spark, ["a", "b"]).count() == 5
    with pytest.raises(ValueError, match="already"):
        sets.register("a", lambda s: s.range(1))


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, value double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "metric string, value double")
    merged = writers.merged_summary(old, new)
    assert writers.summary_json(merged).first().summary == '{"a":1.0,"b":3.0,"c":4.0}'
    tracks = spark.createDataFrame([("s", 1, 0, 1.0, 2.0, 4.0, 6.5), ("s", 2, -1, 0.0, 0.0, 1.0, 1.0)], "seq string, frame int, id int, x1 double, y1 double, x2 double, y2 double")
    writers.mot_lines(tracks, str(tmp_path / "mot"))
    assert [r.value for r in spark.read.text(str(tmp_path / "mot")).collect()] == ["1,0,1.00,2.00,3.00,4.50,1,-1,-1,-1"]
    bad = spark.createDataFrame([("k1",)], "key string")
    writers.quarantine(bad, str(tmp_path / "bad"), ["key"])
    writers.quarantine(bad.union(spark.createDataFrame([("k2",)], "key string")), str(tmp_path / "bad"), ["key"])
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_report_tree(spark, tmp_path):
    folder = tmp_path / "p10" / "p10001"
    folder.mkdir(parents=True)
    (folder / "s5.txt").write_text("line one\nline two\n")
    row = readers.report_tree(spark, str(tmp_path)).first()
    assert (row.group, row.patient, row.study, row.text) == ("p10", "p10001", "s5", "line one\nline two\n")


def test_components_with_hubs(spark):
    from corvane.operators.components import connected_components

    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000 + i, 399) for i in range(50)] + [(7000, 7000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df, many_edges=0).collect()}
    assert got == {r.node: r.component for r in connected_components(df).collect()}
    assert {got[i] for i in (0, 7, 399, 5049)} == {0} and {got[1000 + i] for i in range(41)} == {1000} and got[7000] == 7000
