"""Micro fixtures of the text, label, geometry and metric functions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import labels as L
from corvane.functions import metrics as M
from corvane.functions import text as X
from corvane.operators import conversation as C


@pytest.fixture()
def one(spark):
    """The value of a column over one row of given fields."""

    def run(column, schema="x int", *values):
        return spark.createDataFrame([tuple(values) if values else (1,)], schema).select(column.alias("v")).first().v

    return run


def test_tags_and_reference(one):
    text = "Findings: The [heart](heart) is [big](cardiomegaly)."
    tags = one(X.tags(F.lit(text)))
    assert [(t.phrase, t.target, t.start, t.end) for t in tags] == [("heart", "heart", 14, 19), ("big", "cardiomegaly", 23, 26)]
    plain = one(X.untagged(F.lit(text)))
    assert plain == "Findings: The heart is big." and all(plain[t.start : t.end] == t.phrase for t in tags)
    assert one(X.tags(F.lit("none"))) == []


def test_padded_target_keeps_places(one):
    tags = one(X.tags(F.lit("[a](  x  ) [b](y)")))
    plain = one(X.untagged(F.lit("[a](  x  ) [b](y)")))
    assert all(plain[t.start : t.end] == t.phrase for t in tags) and tags[0].target == "x"


@pytest.mark.parametrize(("text", "out"), [("  chest film shows  ", "Chest film shows."), ("short", None), ("Already fine now.", "Already fine now.")])
def test_caption(one, text, out):
    assert one(X.caption(F.lit(text))) == out


@pytest.mark.parametrize(("text", "out"), [("Clear lungs. Dr X was told. End.", "Clear lungs."), ("Dr X called. Clear.", ""), ("All clear.", "All clear.")])
def test_note_cut(one, text, out):
    assert one(X.cut_at_note(F.lit(text))) == out


@pytest.mark.parametrize(("text", "ok"), [("Findings: a Impression: b", True), ("Findings: Impression: b", False), ("a", False), (None, False)])
def test_well_formed(one, text, ok):
    assert one(X.well_formed(F.lit(text).cast("string"))) is ok


def _sections(text):
    """The rules of the section splitter, walked along a text."""
    known = lambda n: X.SECTION_ALIASES.get(n) or next((w for w in X.SECTION_WORDS if w in n), None) or ("findings" if any(v in n for v in X.VIEW_WORDS) else n)
    found, at = [], 0
    while m := re.compile(r"\n ([A-Z ()/,-]+):\s").search(text, at):
        found.append((known(m[1].strip().lower()), m.start(), m.start(1), m.end()))
        at = text.find("\n", m.end())
        if at < 0:
            break
    stops = [f[1] for f in found[1:]] + [len(text)]
    out = [("preamble", text[: found[0][2]], 0)] if found else [("full report", text, 0)]
    out += [(n, text[e:stop], e) for (n, _, _, e), stop in zip(found, stops, strict=False)]
    out = [s for s in out if s[0] not in ("impression", "findings") or s[1].strip()]
    if not {s[0] for s in out} & {"impression", "findings"} and "\n \n" in out[-1][1]:
        n, body, start = out.pop()
        head, _, tail = body.partition("\n \n")
        out += [(n, head, start), ("last_paragraph", tail, start + len(head))]
    return out


TRICKY = [
    "top\n FINDINGS: clear\n\n IMPRESSION: fine\n", "no header", "", "x\n HISTORY: cough\nmore\n \nlast words\n", "x\n CONCLUSION: all well\n \nrest\n \nend", "a\n IMP: ok\n \nb\n \nc", "\n CHEST, PA LATERAL:\n\n INDICATION:  pain\n \n one\n \n two",
    "p\n FINDINGS:\n IMPRESSION: same line\n IMPRESSION: next", "p\n FINDINGS:  \n\n IMPRESSION: \t \n", "p\n EXAM: HISTORY: none\n WET READ: x", "p\n IMPRESSON: typo\n FINDINDGS: \u00a0\n", "p\n DATE: 1\n X: y\u2003z\n \n", "\u00e9\n TECHNIQUE:\u00a0a\n \nb", "p\n TECHNIQUE: a", "p\n COMPARISON: 1\n \n 2\n \n 3\n ADDENDUM: 4\n \n 5\n \n 6",
]


def test_sections_by_header(spark):
    rng = random.Random(8)
    parts = ["\n FINDINGS:", "\n IMPRESSION: ", "\n CONCLUSION:\n", "\n \n", "\n", " ", "words here", "\n PORTABLE CHEST: ", "HISTORY: ", "\n TECHNIQUE: ", ":", "\n  ODD: "]
    texts = TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", X.sections(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [tuple(s) for s in r.s] == ([] if r.i < 0 else _sections(texts[r.i])), texts[r.i]


def test_overridden_sections(spark):
    reports = spark.createDataFrame([("a", "0123456789"), ("b", "x\n NOTE: one\n EXAM: two\n NOTE: three"), ("c", "x")], "study string, text string")
    by_hand, rest = X.overridden(reports, "study", "text", spark.createDataFrame([("b", "note")], "study string, name string"), spark.createDataFrame([("a", 2, 5)], "study string, first int, last int"))
    assert {tuple(r) for r in by_hand.collect()} == {("a", "findings", "234"), ("b", "note", "three")} and [r.study for r in rest.collect()] == ["c"]


def test_sections_over_arrow(spark):
    df = spark.createDataFrame([("top\n FINDINGS: clear\n",), (None,), ("plain",)], "t string")
    got = df.select(X.sections(F.col("t")).alias("s")).collect()
    assert [len(r.s or []) for r in got] == [2, 0, 1]


def test_phrases_and_marks(one):
    assert one(X.phrases(F.lit("x <p>left lung</p> y <p>heart</p>"))) == ["left lung", "heart"]
    assert one(X.paired(F.lit("<p>a</p><p>b</p>"))) and not one(X.paired(F.lit("<p><p>a</p></p>"))) and not one(X.paired(F.lit("</p>")))
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(7).alias("end")))
    assert one(X.marked(F.lit("a heart b"), spans)) == "a<p> heart</p> b"


@pytest.mark.parametrize(("names", "said"), [(["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c"), ([], "")])
def test_listed(one, names, said):
    column = F.array(*map(F.lit, names)).cast("array<string>")
    assert one(X.listed(column)) == said


@pytest.mark.parametrize(("text", "score"), [("Analysis: ok Score: 7.", 7.0), ("no score", 0.0), ("score: 8.5", 8.5)])
def test_score(one, text, score):
    assert one(X.score_of(F.lit(text))) == score


def test_phrase_key(one):
    assert one(X.phrase_key(F.lit("The  Left Lungs"))) == "left lung"
    assert one(X.phrase_key(F.lit("masses of opacities"))) == "mass of opacity"


def test_small_text_helpers(one):
    assert one(X.hard_cut(F.lit("q" * 2000), F.lit(True))).endswith("\n<image>")
    assert one(X.stopped(F.lit("answer###rest"), ["###"])) == "answer"
    assert one(X.model_name(F.lit("/a/run/checkpoint-5/"))) == "run_checkpoint-5"
    assert one(X.results(F.array(F.struct(F.lit("a").alias("name"), F.lit(True).alias("positive"))))) == "Results: a: yes."
    assert one(X.flat(F.lit("a\r\tb\nc"), " ")) == "ab c"
    assert one(X.section_name(F.lit("CONCLUSION"))) == "impression" and one(X.section_name(F.lit("portable chest"))) == "findings"


def test_condition_ladder(one):
    cols = {"A": F.lit(1.0), "B": F.lit(0.0), "C": F.lit(-1.0), "D": F.lit(None).cast("double")}
    pos, neg = L.condition_names(F.lit(None).cast("double"), cols)
    assert (one(pos), one(neg)) == (["A"], ["B", "D"])
    pos, neg = L.condition_names(F.lit(1.0), cols)
    assert (one(pos), one(neg)) == ([], ["A", "B", "C", "D"])


def test_label_helpers(one):
    assert [one(L.modality_group(F.lit(m))) for m in ("T1 MRI", "CT", "contrast-enhanced CT", "PET", "X-ray")] == ["mri", "ct", "ct", "pet", "x-ray"]
    assert one(L.first_true({"a": F.lit(False), "b": F.lit(True)})) == "b"
    assert one(L.path_key(F.lit("/d/p10/s5/view1.nii.gz"), 3, 1)) == "p10-s5-view1"
    assert one(L.kept_targets(F.array(F.lit("lng"), F.lit("x"), F.lit("lung")), {"lng": "lung"}, ["lung"])) == ["lung"]
    assert one(L.orientation(F.array(F.lit(3.0), F.lit(1.0), F.lit(1.0)), F.array(F.lit(9), F.lit(5), F.lit(5)))) == 0


def _box(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_boxes(one):
    assert [one(c) for c in G.corners(_box(5, 5, 4, 2))] == [3, 4, 7, 6]
    assert [one(c) for c in G.centred(_box(3, 4, 7, 6))] == [5, 5, 4, 2]
    assert one(G.iou(_box(0, 0, 2, 2), _box(1, 1, 3, 3))) == pytest.approx(1 / (7 + 1e-6))
    assert one(G.touching([(F.lit(0), F.lit(1))], [(F.lit(1), F.lit(2))]))
    assert one(G.nearest_multiple(F.lit(6))) == 4 and one(G.nearest_multiple(F.lit(100))) == 64
    assert one(G.window_starts(F.lit(10), 4)) == [0, 2, 4, 6] and one(G.window_starts(F.lit(3), 4)) == [0]
    assert one(G.fitting_side(F.lit(100), F.lit(0.5))) == max(t for t in range(1, 100) if t * int(np.ceil(0.5 * t)) <= 100)
    assert one(G.inverse_sigmoid(F.lit(0.5))) == pytest.approx(0)


def test_set_and_gram_metrics(spark, one):
    p, r, f = M.set_scores(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d")))
    assert (one(p), one(r)) == (0.5, pytest.approx(1 / 3)) and one(f) == pytest.approx(0.4)
    assert M.sentence_bleu("the cat sat on", "the cat sat on the mat", 4) == pytest.approx(np.exp(1 - 6 / 4))
    assert M.sentence_bleu("", "a", 1) == 0 and M.sentence_rouge_l("a b c", "a x c") == pytest.approx(2 / 3)
    assert one(M.bleu1(F.lit("a a b"), F.lit("a b b c"))) == pytest.approx(M.sentence_bleu("a a b", "a b b c", 1))
    assert one(M.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5)


def test_rates_and_dice(spark, one):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "r int, p int")
    row = df.agg(*M.confusion(F.col("r"), F.col("p")), M.false_omission_rate(F.col("r"), F.col("p")).alias("f")).first()
    assert (row.tp, row.fp, row.fn, row.f) == (1, 0, 1, pytest.approx(1 / 3))
    assert one(M.f1(F.lit(1), F.lit(0), F.lit(1))) == pytest.approx(2 / 3)
    assert one(M.dice(F.lit(0), F.lit(0), F.lit(0))) == 1.0 and one(M.dice(F.lit(0), F.lit(3), F.lit(0))) == 0.0


def test_conversation_helpers(one):
    labels = C.masked_labels(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7)), 2, 10)
    assert (one(labels[0]), one(labels[1])) == ([5, 6, 7, 2], [-100, -100, 7, 2])
    assert one(C.position_ids(F.array(*map(F.lit, [9, 1, 5, 2, 9])), 1, 2)) == [0, 1, 1, 1, 2]
    assert [(c.start, c.end, c.part) for c in one(C.chunked(F.array(*map(F.lit, range(5))), 2))] == [(0, 2, [0, 1]), (2, 4, [2, 3]), (4, 5, [4])]
    turns = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in (("user", "hi"), ("assistant", "yo"), ("user", ""))))
    assert one(C.rendered(turns, "single")) == "user: hi###assistant: yo###user:"
    assert one(C.rendered(turns, "plain")) == "hi\nyo\n\n"
    assert one(C.few_shot("s", [("q", "a")], F.lit("z")))[-1].text == "z"
    assert one(C.kept_spans(F.array(*map(F.lit, [1, 2, 1])), 2, F.array(F.lit(True), F.lit(False)))) == [True]
