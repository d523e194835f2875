import heapq
import time

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from corvane.llm.common import texts_of
from corvane.llm.piece_codec import LONG, Vocabulary, _segment, decoded, dropped, encode_texts, encoded
from corvane.llm.queries import PIECE_MODEL

MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
VOC = Vocabulary.load(PIECE_MODEL)
PIECES = {MODEL.id_to_piece(i): i for i in range(MODEL.get_piece_size()) if not (MODEL.is_byte(i) or MODEL.is_control(i) or MODEL.is_unknown(i))}


def _agenda(unit, key, rate):
    """The plain agenda: a heap of candidates, each skipped for good if its hash says so."""
    text = [c.replace(" ", "▁") if c != "▁" else "\0" for c in unit]
    ids, alive = [PIECES.get(c) for c in text], [True] * len(text)
    after, before, heap = [i + 1 for i in range(len(text))], [i - 1 for i in range(len(text))], []

    def offer(a, b):
        if a >= 0 and b < len(text) and ids[a] is not None and ids[b] is not None and (m := PIECES.get(text[a] + text[b])) is not None:
            heapq.heappush(heap, (-MODEL.get_score(m), a, b, text[a], text[b], m))

    for i in range(len(text) - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, left, right, m = heapq.heappop(heap)
        if not (alive[a] and alive[b] and after[a] == b and (text[a], text[b]) == (left, right)):
            continue
        if rate and dropped(np.uint64([key]), np.array([a]), np.array([ids[a]]), np.array([ids[b]]), rate)[0]:
            continue
        ids[a], text[a], alive[b], after[a] = m, left + right, False, after[b]
        if after[b] < len(text):
            before[after[b]] = a
        offer(before[a], a)
        offer(a, after[a])
    out, i = [], 0
    while i < len(text):
        out += [VOC.byte_id[x] for x in unit[i].encode()] if ids[i] is None else [ids[i]]
        i = after[i]
    return out


def test_agenda_in_step_matches_plain_agenda(docs):
    words = " ".join(r.text for r in docs.select("text").limit(40).collect() if r.text).split()[:200]
    for unit in [" " + w for w in words] + ["    ab", " 日é本", "a▁b", "\n"]:
        points = np.array([ord(c) for c in unit], np.uint32)
        for key, rate in ((1, 0.0), (7, 0.3), (8, 0.9)):
            got, _ = _segment(VOC, points, np.array([0, len(points)]), np.uint64([key]), rate)
            assert got.tolist() == _agenda(unit, key, rate)


def test_long_units_match_plain_agenda(docs):
    text = "".join(r.text for r in docs.select("text").limit(40).collect() if r.text).replace(" ", "").replace("\n", "")
    for unit in (text[:3000], "a" * (LONG + 1), "日本語の文章" * 90, text[500 : 500 + LONG + 1] + "▁é\U0001f600"):
        points = np.array([ord(c) for c in unit], np.uint32)
        for key, rate in ((1, 0.0), (7, 0.3), (2**63 + 5, 0.9)):
            got, _ = _segment(VOC, points, np.array([0, len(points)]), np.uint64([key]), rate)
            assert got.tolist() == _agenda(unit, key, rate)


def test_long_and_short_units_of_one_run(docs):
    text = "".join(r.text for r in docs.select("text").limit(20).collect() if r.text).replace(" ", "")
    units = [" ab", text[:1000], " word", "x" * 400, " end"]
    points = np.array([ord(c) for u in units for c in u], np.uint32)
    first = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    keys = np.arange(1, 6, dtype=np.uint64)
    got, at = _segment(VOC, points, first, keys, 0.2)
    for k, u in enumerate(units):
        assert got[at[k] : at[k + 1]].tolist() == _agenda(u, int(keys[k]), 0.2)


def test_a_million_characters_without_a_space_take_seconds(spark):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"), 1_000_000))
    began = time.perf_counter()
    ids, _ = encode_texts(VOC, *texts_of(pa.array([text])), np.array([1]), 0.1, 3)
    assert time.perf_counter() - began < 60
    assert MODEL.decode(ids.tolist()) == text


def test_no_dropout_is_the_model(docs):
    texts = [r.text or "" for r in docs.select("text").collect()]
    ids, at = encode_texts(VOC, *texts_of(pa.array(texts)), np.arange(len(texts)), 0.0, 1, 1)
    for i, t in enumerate(texts):
        if "▁" not in t:
            assert ids[at[i] : at[i + 1]].tolist() == MODEL.encode(t)


def test_dropout_varies_and_is_lossless(docs, empty_docs):
    carry = ("text", "fp")
    rows = encoded(docs, VOC, 0.2, 5, carry=carry)
    back = decoded(rows, VOC, carry=("doc_id", "text", "piece_ids", "fp")).collect()
    assert len(back) == docs.count() and all(r.decoded == (r.text or "") and r.fp == "clash" for r in back)
    assert all(MODEL.decode(r.piece_ids) == r.text for r in back if r.text and "▁" not in r.text)
    same = encoded(docs, VOC, 0.2, 5).agg(F.sum(F.xxhash64("piece_ids").cast("decimal(30,0)"))).first()
    assert same == rows.agg(F.sum(F.xxhash64("piece_ids").cast("decimal(30,0)"))).first()
    assert same != encoded(docs, VOC, 0.2, 6).agg(F.sum(F.xxhash64("piece_ids").cast("decimal(30,0)"))).first()
    assert encoded(empty_docs, VOC).count() == 0


def test_copies_in_other_documents_differ(spark):
    text = "international organisations understand segmentation " * 5
    rows = encoded(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string"), VOC, 0.2)
    assert rows.select("piece_ids").distinct().count() > 15


def test_a_word_has_more_than_a_few_segmentations(spark):
    word = " internationalisation"
    ids, at = encode_texts(VOC, *texts_of(pa.array([word * 50] * 40)), np.arange(40), 0.3, 1)
    back = decoded(encoded(spark.createDataFrame([(i, word * 50) for i in range(4)], "doc_id long, text string"), VOC, 0.3), VOC, carry=("doc_id",))
    assert {r.decoded for r in back.collect()} == {word * 50}
    seen = set()
    for a, b in zip(at, at[1:], strict=False):
        unit = []
        for i in ids[a:b].tolist():
            if MODEL.id_to_piece(i).startswith("▁") and unit:
                seen.add(tuple(unit))
                unit = []
            unit.append(i)
    assert len(seen) > 20
