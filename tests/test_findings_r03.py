"""Tests of the third round's findings."""

from __future__ import annotations

import duckdb
import pytest
import __spark_entry__ as entry


def _agrees(spark, tmp_path, query: str, **tables: str) -> int:
    """Whether a query over tables made by SQL equals its twin; the number of rows."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"create table {name} as {sql}")
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    got = entry.queries()[query](spark, str(tmp_path)).toPandas()
    con.register("got", got)
    names = ", ".join(f'"{c}"' for c in got.columns)
    con.execute(f"create table want as {entry.oracle_sql()[query]}")
    for a, b in (("want", "got"), ("got", "want")):
        assert not con.execute(f"select {names} from {a} except all select {names} from {b}").fetchall()[:3]
    return len(got)


def test_special_cases_with_numbers_of_five_digits(spark, tmp_path):
    assert _agrees(spark, tmp_path, "q109_special_cases", supplier="select 990 + i * 997 as s_suppkey from range(40) t(i) union all select 10000 + i from range(12) t(i) union all select 1000") == 7 * 53


def _exchanged(df) -> list[str]:
    """The operators of a query's plan as Spark would run it."""
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_whole_sequences_shuffle_no_copies_of_rows(spark, tmp_path):
    rows = "select i // 4 l_orderkey, cast(case when i % 16 = 5 then 1 when i % 36 = 9 then null else i % 4 + 1 end as int) l_linenumber, case when i % 52 = 7 then 'F' when i % 28 = 3 then null else 'O' end l_linestatus from range(400) t(i)"
    assert _agrees(spark, tmp_path, "q73_whole_sequences", lineitem=rows) == 2
    plan = _exchanged(entry.queries()["q73_whole_sequences"](spark, str(tmp_path)))
    assert not any("Expand" in line for line in plan) and sum("Scan parquet" in line or "FileScan" in line for line in plan) == 1


def test_surface_scores_take_small_boxes_at_once_and_wide_ones_by_blocks(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from corvane.operators import surfaces as U

    calls, whole = [], U.distance_transform
    monkeypatch.setattr(U, "distance_transform", lambda *a: calls.append(1) or whole(*a))
    rng = np.random.default_rng(3)
    of = np.repeat(np.arange(60), 80)
    at = [rng.integers(0, 7, len(of)) for _ in range(3)]
    codes = [rng.integers(0, 256, len(of)) for _ in range(2)]
    first = np.unique(np.stack([of, *at]), axis=1, return_index=True)[1]
    of, at, codes = of[first], [a[first] for a in at], [c[first] for c in codes]
    areas, spacing = np.array(U.surface_areas((1.5, 1.0, 0.75))), (1.5, 1.0, 0.75)
    many = U._scored(of, at, codes, 60, areas, spacing, 1.0, 95.0)
    assert not calls  # no transform of a case by itself
    monkeypatch.setattr(U, "SMALL_BOX", 0)
    assert np.allclose(many, U._scored(of, at, codes, 60, areas, spacing, 1.0, 95.0), equal_nan=True) and calls

    cells = np.unique(rng.integers(-3, 71, (400, 3)), axis=0)
    marks = rng.integers(0, 4, len(cells))
    table = pd.DataFrame({"k": 1, "z": cells[:, 0], "y": cells[:, 1], "x": cells[:, 2], "a": marks % 2 == 1, "b": marks > 1})
    want = {}
    for (z, y, x), a, b in zip(cells.tolist(), table.a, table.b, strict=True):
        for k, (dz, dy, dx) in enumerate(U._CORNERS):
            c = want.setdefault((z + 1 - dz, y + 1 - dy, x + 1 - dx), [0, 0])
            c[0] |= int(a) << k
            c[1] |= int(b) << k
    want = {(*k, *v) for k, v in want.items() if any(0 < c < 255 for c in v)}
    given = spark.createDataFrame(pd.concat([table, table]))
    got = [tuple(r)[1:] for r in U.surface_corners(given, ["k"], ["z", "y", "x"], ["a", "b"]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_contour_consensus_makes_no_row_a_cell(spark, tmp_path):
    rows = "select i // 6 l_orderkey, cast(i * 5 % 7 + 1 as int) l_linenumber, i * 3 % 5 l_suppkey, (i * 7 % 50)::double l_quantity, (i * 3 % 11) / 100.0::double l_discount, (i * 5 % 9) / 100.0::double l_tax from range(600) t(i)"
    assert _agrees(spark, tmp_path, "q142_contour_consensus", lineitem=rows) == 27
    plan = _exchanged(entry.queries()["q142_contour_consensus"](spark, str(tmp_path)))
    assert not any("Generate" in line for line in plan)


def test_tasks_of_volumes_follow_from_their_cells(spark):
    from corvane.operators import patches as P

    v = spark.range(64).selectExpr("id k", "100 a", "100 b", "100 c")
    made = P.spread_volumes(v.coalesce(1), ["k"], ["a", "b", "c"])
    assert made.rdd.getNumPartitions() == -(-64_000_000 // (1 << 19)) and made.count() == 64


def test_slot_matches_of_many_groups_are_those_of_each(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from corvane.operators import boxes as B

    rng, rows, want = np.random.default_rng(5), [], {}
    for g in range(300):
        n, m, free = int(rng.integers(1, 6)), int(rng.integers(0, 5)), int(rng.integers(0, 3))
        cost, p = rng.random((n, m)).round(1), rng.random(n).round(1)
        found = B.slots(cost, 1 - p, p, free)
        want |= {(g, q): int(found[q]) * 3 + 1 if found[q] >= 0 else int(found[q]) for q in range(n)}
        rows += [(g, q, float(t * 3 + 1) if m else None, float(cost[q, t]) if m else 0.0, float(p[q]), float(free)) for q in range(n) for t in range(max(m, 1))]
    def alone(*a):
        raise AssertionError("a group by itself")
    monkeypatch.setattr(B, "slots", alone)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "q", "t", "cost", "p", "free"]).astype({"t": "float64"})).selectExpr("g", "q", "nullif(t, double('NaN')) t", "cost", "p", "free")
    packed = df.toPandas().sort_values(["g", "q", "t"], kind="stable").reset_index(drop=True)
    seen = {}

    def fake(df, group, fields, run, schema, many=None):
        arrays = {f: packed[f].to_numpy() for f in fields}
        offsets = np.concatenate([[0], packed.groupby("g").size().cumsum()])
        done, owner, out = many(arrays, offsets)
        assert done.all()
        seen.update({(int(g), int(q)): int(x) for g, q, x in zip(owner, out["q"], out["match"], strict=True)})

    monkeypatch.setattr(B, "per_group", fake)
    B.slot_matches(df, ["g"], "q", "t", "cost", "p", "free")
    assert seen == want


def test_stream_sequences_wait_by_spans(spark, tmp_path, monkeypatch):
    from corvane.streaming import tracks as T

    monkeypatch.setattr(T, "SPAN", 16)
    rows = "select i event_id, timestamp '2024-01-01' + interval (i) minute ts, i * 7 % 5 user_id, case when i % 3 = 0 then 'a' else 'b' end event_type, (i * 37 % 200)::double as value, '' props from range(120) t(i)"
    assert _agrees(spark, tmp_path, "q137_stream_sequences", events=rows) == 120


@pytest.mark.parametrize("query", ["q125_same_rater_merge", "q49_mean_box_cluster"])
def test_box_tasks_follow_from_the_rows(spark, tmp_path, monkeypatch, query):
    from corvane import session

    monkeypatch.setattr(session, "MANY_ROWS", 150)  # 11 tasks where the session has 8
    rows = "select i // 6 l_orderkey, cast(i * 5 % 3 + 1 as int) l_linenumber, i l_partkey, i * 3 % 5 l_suppkey, i::double l_extendedprice, (i * 7 % 9)::double l_quantity, (i * 3 % 4) / 100.0::double l_discount, (i * 5 % 3) / 100.0::double l_tax, chr(cast(65 + i // 96 % 2 as int)) l_returnflag from range(1600) t(i)"
    assert 0 < _agrees(spark, tmp_path, query, lineitem=rows) < 1600  # some are merged
    plan = _exchanged(entry.queries()[query](spark, str(tmp_path)))
    assert any("REPARTITION_BY_NUM" in line for line in plan) and not any("ENSURE_REQUIREMENTS" in line and "hashpartitioning" in line for line in plan)
