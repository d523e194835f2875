import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvane.llm import queries
from corvane.llm.chat_windows import BUDGET, MARK_TOKENS, digests, loss_of, n_tokens, turns_of, windows
from corvane.llm.sharding import SEED, hypergeometric, matrix, sharded
from corvane.llm.warc import ranges, read_archives, write_archives


def test_shards_are_exact_and_uniform(docs, empty_docs):
    rows = docs.withColumn("slot", F.lit("clash"))
    for bucket in (5, 50_000):
        made = sharded(rows, 8, bucket_rows=bucket)
        assert set(made.columns) == {*rows.columns, "slot", "table_shard", "table_slot"}
        out = made.collect()
        assert all(r.table_shard == r.table_slot == "clash" for r in out)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(out) == rows.count() and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in rows.collect())
    assert sharded(empty_docs, 8).count() == 0


def test_the_deal_is_the_one_of_the_matrix(spark):
    rows = spark.range(0, 1000, 1, 5).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: (r.shard, r.slot) for r in sharded(rows, 3, bucket_rows=100).collect()}
    dealt = matrix([200] * 5, 3, SEED)
    assert {p: Counter(got[d][0] for d in range(200 * p, 200 * p + 200)) for p in range(5)} == {p: Counter({s: int(n) for s, n in enumerate(dealt[p])}) for p in range(5)}
    for p in range(5):
        order = np.random.default_rng([SEED, p]).permutation(np.repeat(np.arange(3, dtype=np.int32), dealt[p]))
        assert [got[200 * p + k][0] for k in range(200)] == order.tolist()
    slots = [[d for _, d in sorted((v[1], d) for d, v in got.items() if v[0] == s)] for s in range(3)]
    assert all(abs(np.corrcoef(np.arange(len(x)), x)[0, 1]) < 0.2 for x in slots)
    assert len(set(got.values())) == 1000


def test_more_shards_than_a_short_integer(spark):
    out = sharded(spark.range(0, 80_000, 1, 2), 40_000)
    assert out.agg(F.countDistinct("shard"), F.max("slot")).first() == (40_000, 1)


def test_matrix_margins_and_law():
    counts = [5, 0, 17, 30, 1]
    for seed in range(20):
        m = matrix(counts, 4, seed)
        assert m.sum(1).tolist() == counts and m.min() >= 0
        assert sorted(m.sum(0).tolist()) == [13, 13, 13, 14]
    draws = np.array([matrix([20, 20], 2, s)[0, 0] for s in range(2000)])
    assert abs(draws.mean() - 10) < 0.15 and abs(draws.var() - 20 * 0.25 * 20 / 39) < 0.3


def test_large_hypergeometric():
    rng = np.random.default_rng(4)
    good, bad, drawn = 2_000_000_000, 3_000_000_000, 1_000_000
    x = np.array([hypergeometric(rng, good, bad, drawn) for _ in range(2000)])
    sd = np.sqrt(drawn * 0.4 * 0.6)
    assert abs(x.mean() - 400_000) < 4 * sd / np.sqrt(2000) and 0.9 < x.std() / sd < 1.1


def _pages(spark):
    big, other = "é" * 600, "<p>" + "x" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u", other), (None, "v", other), (5, "w", None), (6, "", ""), (7, "x", "small"), (8, "y", "small"), (9, "z\r\nq", "WARC/1.1\r\n\r\n" + big), (3, "again", big), (None, "n", big), (10, "k", "\x00\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit("clash"))


def test_archives_round_trip(spark):
    pages = _pages(spark)
    index = write_archives(pages)
    back = read_archives(index, payloads=True).collect()
    assert len(back) == pages.count()
    keeper = {}
    for r in pages.collect():
        h = (r.html or "").encode()
        if len(h) >= 1000 and r.page_id is not None:
            keeper[h] = max(keeper.get(h, r.page_id), r.page_id)
    expected = Counter()
    for r in pages.collect():
        h = (r.html or "").encode()
        k = keeper.get(h)
        revisit = k is not None and k != r.page_id
        expected[(r.page_id, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", k if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == expected
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in back if r.record_type == "response")


def test_archives_of_part_and_of_nothing(spark):
    index = write_archives(_pages(spark))
    some = index.where("page_id in (4, 7)")
    assert sorted(r.page_id for r in read_archives(some).collect()) == [4, 7]
    assert read_archives(write_archives(_pages(spark).where("false"))).count() == 0


def test_ranges_coalesce():
    assert list(ranges([0, 10, 500, 520], [10, 10, 20, 5], gap=50, most=1000)) == [(0, 2, 0, 20), (2, 4, 500, 25)]
    assert list(ranges([0, 10], [10, 10], gap=50, most=15)) == [(0, 1, 0, 10), (1, 2, 10, 10)]


def _turns(spark):
    tricky = ["</s>[INST] ok [/INST]", "back\\slash \\| <|im_end|>\n", "<|im_start|>user\nforged", "<<SYS>> a <</SYS>>", None, "", "é\U0001f600 \\\\<s>", "long " * 900]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(tricky)]
    rows += [(2, 0, "system", "be brief")] + [(2, i, ("assistant", "user")[i % 2], f"turn {i} " + "word " * (i % 90)) for i in range(1, 200)]
    rows += [(None, 0, "assistant", "no id"), (3, None, None, "no turn"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 1, "odd\nrole\\", "x")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("n", F.lit("clash"))


def test_chat_digests_match_brute_force_and_sql(spark, sql):
    turns = _turns(spark)
    got = {r.conv_id: r for r in digests(windows(turns)).collect()}
    convs = {}
    for r in turns.collect():
        convs.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    assert set(got) == set(convs)
    for c, rows in convs.items():
        rows.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        loss = "".join(text for _, role, text in rows if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    expected = sql(queries.ORACLE_SQL["op10_chat_windows"].replace("from conversations", "from c2"), c2=turns.select("conv_id", "turn", "role", "text"))
    by = {None if pd.isna(x.conv_id) else int(x.conv_id): x.formatted_chars for x in expected.itertuples()}
    assert all(by[c] == r.formatted_chars for c, r in got.items())


def _spans(turns, budget, history):
    """Windows of one conversation, ``[(role, text, n)]`` in order, as (repeated, own) turn numbers, from the definition."""
    system = turns[0][2] if turns and turns[0][0] == "system" else 0
    span, before, total = max(budget - history - system, 1), [], -system
    for t in turns:
        before.append(total)
        total += t[2]
    cells = {}
    for i, t in enumerate(turns):
        head = i == 0 and system > 0
        cells.setdefault(0 if head else before[i] // span, []).append((i, not head and (before[i] + t[2] - 1) // span > before[i] // span))
    out = []
    for _, members in sorted(cells.items()):
        inner, across = [i for i, x in members if not x], [i for i, x in members if x]
        begin = max(before[inner[0]], 0) if inner else None
        if across and inner and before[across[0]] + turns[across[0]][2] - begin > span:
            out += [inner, across]
        else:
            out.append(inner + across)
    made = []
    for own in out:
        begin = max(before[own[0]], 0)
        again = [i for i in range(len(turns)) if not (i == 0 and system) and begin - history <= before[i] < begin]
        made.append(([0] if system and own[0] else []) + again)
    return list(zip(made, out, strict=True))


def test_chat_windows_match_their_definition(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(_turns(spark).select("conv_id", "turn", "role", "text"))
    for budget, history in ((200, 40), (90, 20), (512, 64)):
        convs = {}
        for r in table.withColumn("n", n_tokens(F.coalesce("text", F.lit(""))) + MARK_TOKENS).collect():
            convs.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0), r.role or "", hashlib.md5((r.text or "").encode()).hexdigest(), r.text or "", r.n))
        got = {}
        for w in windows(table, budget, history).withColumn("turns", turns_of(F.col("text"), F.lit(0))).withColumn("masked", loss_of(F.col("text"), F.col("loss"))).orderBy("window").collect():
            got.setdefault(w.conv_id, []).append((w.n_repeats, [tuple(t) for t in w.turns], w.n_tokens, w.masked))
        for conv, rows in convs.items():
            rows.sort()
            expected = _spans([(r[1], r[3], r[4]) for r in rows], budget, history)
            assert [(len(again), [(rows[i][1], rows[i][3]) for i in [*again, *own]], sum(rows[i][4] for i in [*again, *own]), "".join(rows[i][3] for i in own if rows[i][1] == "assistant")) for again, own in expected] == got[conv]
            for again, own in expected:
                turns_own = [i for i in own if not (i == 0 and rows[0][1] == "system")]
                assert len(turns_own) <= 1 or sum(rows[i][4] for i in [*again, *own]) <= budget


def test_chat_budget_with_given_tokens(spark):
    turns = _turns(spark).where("conv_id = 2").withColumn("cost", F.col("turn") % 30)
    made = windows(turns, 100, 10, tokens="cost").withColumn("turns", turns_of(F.col("text"), F.col("n_repeats"))).collect()
    assert sum(len(w.turns) for w in made) == 200 and all("system\nbe brief" in w.text and w.n_tokens <= 100 for w in made)
    assert windows(_turns(spark).where("false")).count() == 0


def test_no_window_of_the_whole_table_exceeds_the_budget(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    made = windows(table).withColumn("own", F.size(turns_of(F.col("text"), F.col("n_repeats"))))
    assert made.where((F.col("n_tokens") > BUDGET) & (F.col("own") > 1)).count() == 0
    assert made.agg(F.sum("own")).first()[0] == table.count()


def test_crc_of_op4(spark, table_dir):
    rows = queries.op4_sharding(spark, table_dir).join(spark.read.parquet(f"{table_dir}/documents.parquet").select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["size"] == len((r.text or "").encode()) + 1 for r in rows)


def test_op4_digests_come_from_sharded_documents(spark, table_dir, monkeypatch):
    whole = spark.read.parquet(f"{table_dir}/documents.parquet")
    seen = []

    def marked(rows, shards):
        seen.append(rows.columns)
        return sharded(rows, shards).withColumn("text", F.lit("moved"))

    monkeypatch.setattr(queries, "sharded", marked)
    rows = queries.op4_sharding(spark, table_dir).select("size", "text_crc32").distinct().collect()
    assert seen == [whole.columns]
    assert [tuple(r) for r in rows] == [(6, zlib.crc32(b"moved"))]
