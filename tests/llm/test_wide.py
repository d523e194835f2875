"""Texts longer than one pass of the scans (a megabyte), and joins of sides that aren't broadcast."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_windows, common, decontaminate, quality_gam, quality_rules, sharding, simhash_dedup, warc
from tests.llm.test_dedup import _first_kept, _print
from tests.llm.test_layout import _pages
from tests.llm.test_quality import _base

SCHEMA = "doc_id long, text string"


def _long(seed, words=220_000):
    r = random.Random(seed)
    vocabulary = [f"{'äbc'[r.randrange(3)]}{i}" for i in range(5000)]
    return " ".join(vocabulary[r.randrange(5000)] + ("\n" if i % 97 == 96 else "") for i in range(words))


@pytest.fixture(scope="module")
def rows():
    a, b = _long(1), _long(2)
    assert len(a.encode()) > common.CHUNK_BYTES
    edited = b.split(" ")
    edited[1000] = edited[200_000] = "other"
    return [(1, a), (2, "a short text between two long ones, with a few words more than ten"), (3, b), (4, " ".join(edited)), (5, a + " tail"), (6, None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_quality_rules(table, rows, labels):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(table, labels.where("quality = 1")).collect()}
    assert got == {d: _base(t) for d, t in rows}


def test_fingerprints_and_near_duplicates(table, rows):
    got = {r.doc_id: r.fingerprint for r in simhash_dedup.near_groups(table).select("doc_id", simhash_dedup.as_hex().alias("fingerprint")).collect()}
    assert {d: int(x, 16) for d, x in got.items()} == {d: _print(t) for d, t in rows}
    kept = simhash_dedup.without_similar(table).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in _first_kept(rows)} == {1, 2, 3, 6}


def test_sharding(table, rows):
    got = {r.doc_id: (r.size, r.crc) for r in sharding.sharded(table, 2).select("doc_id", F.octet_length("text").alias("size"), F.crc32("text").alias("crc")).collect()}
    assert {d: v for d, v in got.items() if d < 6} == {d: (len(t.encode()), zlib.crc32(t.encode())) for d, t in rows if t is not None}


def test_quality_scores_do_not_depend_on_neighbours(spark, table, rows):
    import numpy as np
    import pyarrow as pa

    whole = quality_gam._batch_features(pa.array([t for _, t in rows]))
    each = np.concatenate([quality_gam._batch_features(pa.array([t], pa.string())) for _, t in rows])
    assert np.allclose(whole, each)


def test_decontamination(spark, rows):
    r = random.Random(3)
    item = " ".join(f"item{r.randrange(500)}" for _ in range(40))
    long = rows[0][1]
    docs = spark.createDataFrame([(1, f"{item} {long}"), (2, f"{long} {item}"), (3, long), (4, item)], SCHEMA)
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r.start_word, r.similarity) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {1: (0, 1.0), 2: (220_000, 1.0), 4: (0, 1.0)}


def test_archives(spark, rows):
    pages = spark.createDataFrame([(d, "http://x", t) for d, t in rows] + [(50, "http://y", rows[2][1])], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    body = {d: (t or "").encode() for d, t in rows} | {50: rows[2][1].encode()}
    assert got == {d: (len(x), hashlib.sha1(x).hexdigest(), "revisit" if d == 3 else "response", 50 if d == 3 else None) for d, x in body.items()}


def test_conversations(spark, rows):
    turns = [(7, 0, "user", "short"), (7, 1, "assistant", rows[0][1]), (7, 2, "user", rows[2][1]), (7, 3, "assistant", "end [INST] </s>")]
    made = chat_windows.digests(chat_windows.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    loss = turns[1][3] + turns[3][3]
    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
    assert [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in made] == [(7, 4, hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())]


@pytest.mark.parametrize("module", [decontaminate, sharding, simhash_dedup, warc], ids=lambda m: m.__name__.rpartition(".")[2])
def test_joins_that_shuffle_give_the_same(spark, docs, monkeypatch, module):
    """The side of ``join_checked`` that isn't broadcast, in each operator that takes it."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")

    def made():
        if module is decontaminate:
            return decontaminate.leaks(docs, bench).drop("distance"), decontaminate.decontaminated(docs, bench).select("doc_id", "text")
        if module is sharding:
            return (sharding.sharded(docs.select("doc_id", "text"), 4, bucket_rows=20),)
        if module is warc:
            return (warc.read_archives(warc.write_archives(_pages(spark))).select("page_id", "payload_digest", "record_type", "refers_to"),)
        return (simhash_dedup.without_similar(docs).select("doc_id", "text"),)

    rows = lambda frames: [sorted(map(str, f.collect())) for f in frames]
    want = rows(made())
    monkeypatch.setattr(module, "join_checked", functools.partial(common.join_checked, limit=0))
    assert rows(made()) == want and all(want)
