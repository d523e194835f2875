import functools
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.llm import license_scan as license_module
from corvane.llm import queries
from corvane.llm.common import join_checked
from corvane.llm.decontaminate import doc_key
from corvane.llm.license_scan import TEMPLATES, license_scan, matches, rules, split_words
from corvane.llm.token_counts import byte_pairs, scan_tokens, token_counts


def _same(spark_df, expected):
    a = spark_df.toPandas()
    key = sorted(a.columns)
    rows = lambda df: Counter(tuple(None if pd.isna(v) else (round(v, 6) if isinstance(v, float) else v) for v in r) for r in df[key].astype(object).itertuples(index=False))
    assert rows(a) == rows(expected)


LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
    "Licensed under CC BY-NC 3.0.": "cc-by",
    "Released under the BSD License": "",
    "Released under the Apache License": "",
    "the book was released years ago under the title driving license": "",
    "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
    "This work is licensed under the GNU Lesser General Public License, version 3": "gpl",
    "Licensed under the Apache License, Version 1.0": "",
    "licensed UNDER the apache license\nversion 2.0": "apache-2.0",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": "mpl-2.0",
    "licensed under the terms of the apache license version 2 0": "apache-2.0",
    "Released under the MIT License.\nAll rights reserved. all RIGHTS reserved": "mit,reserved",
    "under the by 4 0 nc cc": "cc-by-nc-4.0",
    "apache " + "word " * 12 + "licensed under the license version 2 0": "",
    'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including': "mit",
    "word " * 300 + "Released under the\nMIT License " + "word " * 300: "mit",
    "": "",
    "This work is licensed under a Creative Commons Attribution 4.0 International License. NonCommercial use": "cc-by-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Attribution": "cc-by-nc-4.0",
    "Licensed under CC BY 4.0, not NC.": "cc-by,cc-by-4.0",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. See version 2": "gpl,gpl-3.0",
    "Licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd-4.0",
    "Licensed under CC BY-NC-SA 4.0 and so on": "cc-by,cc-by-nc-sa-4.0",
    "Licensed under CC BY-ND 4.0": "cc-by,cc-by-nd-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa-4.0",
    "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.": "cc-by,cc-by-4.0,cc-by-nc-4.0",
    "mit license": "mit",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "Licensed under the Apache License, Version 1.0, section 2": "",
    "This work is licensed under the GNU Lesser General Public License version 2. " + "z " * 30 + "Released under the MIT License": "gpl,mit",
}


def test_licenses_match_sql(spark, docs, sql):
    more = spark.createDataFrame([(7000 + i, t) for i, t in enumerate(LINES)] + [(7900, None), (7000, "Released under the MIT License"), (7000, "Released under the MIT License")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more)
    got = license_scan(table.withColumn("found", F.lit("clash")).withColumn("low", F.lit("clash")).withColumn("held", F.lit("clash")))
    _same(got, sql(queries.ORACLE_SQL["op3_license_scan"].replace("from documents", "from d2"), d2=table))
    labels = {(r.doc_id, r.labels) for r in got.where("doc_id >= 7000").collect()}
    assert labels >= {(7000 + i, x) for i, x in enumerate(LINES.values())}


def _blocks(words, rule):
    """From the definition, each block that meets a rule: start, length of its tight part, containment, and whether it tells the label."""
    out = []
    for at, w in enumerate(words):
        block = words[at : at + rule.span]
        hit = len(set(block) & set(rule.words))
        if w not in rule.words or hit < rule.need:
            continue
        met = [j for j in range(1, len(block) + 1) if len(set(block[:j]) & set(rule.words)) >= rule.need]
        full = [j for j in met if set(rule.must) <= set(block[:j])]
        end = full[0] if full else met[0]
        out.append((at, end, round(hit / len(rule.words), 6), bool(full) and not set(rule.barred) & set(block[:end])))
    return out


def _labels(words, made):
    """From the definition, the labels of each label's best blocks that no better one of another label overlaps."""
    told = {(n, -c, at, r.label) for r in made for at, n, c, tells in _blocks(words, r) if tells}
    meet = lambda a, b: a[2] < b[2] + b[0] and b[2] < a[2] + a[0]
    best = [b for b in told if not any(a[3] == b[3] and meet(a, b) and a[:3] < b[:3] for a in told)]
    return {b[3] for b in best if not any(a[3] != b[3] and meet(a, b) and (*a[:2], a[3]) < (*b[:2], b[3]) for a in best)}


KNOWN = {w for r in rules() for w in (*r.words, *r.barred)}


def _noisy(n, seed):
    """Notices with words left out and put in, some one after the other."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.integers(1, 4)):
            own = [w for w in split_words(TEMPLATES[rng.integers(len(TEMPLATES))].text) if rng.random() < 0.93]
            for _ in range(rng.integers(0, 3)):
                own.insert(int(rng.integers(0, len(own) + 1)), str(rng.choice(sorted(KNOWN) + ["x", "y"])))
            words += own + ["pad"] * int(rng.integers(0, 12))
        rows.append((k, " ".join(["pad"] * int(rng.integers(0, 30)) + words)))
    return rows


@pytest.mark.parametrize("limit", [None, 0])
def test_join_finds_every_block(spark, monkeypatch, limit):
    if limit == 0:  # joins that shuffle
        monkeypatch.setattr(license_module, "join_checked", functools.partial(join_checked, limit=0))
    made, rows = rules(), _noisy(250, 9)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = matches(table).join(table.select(doc_key().alias("doc_key"), "doc_id"), "doc_key").collect()
    got = {(r.doc_id, r.label, r.start, r.length, round(r.containment, 6), r.tells) for r in found}
    expected = {(n, r.label, *b) for n, t in rows for r in made for b in _blocks(split_words(t), r)}
    assert got == expected and len(expected) > 500
    base = {"cc-by", "gpl", "reserved"}
    labels = {r.doc_id: set(filter(None, r.labels.split(","))) - base for r in license_scan(table).collect()}
    assert labels == {n: _labels(split_words(t), made) for n, t in rows}
    assert sum(map(bool, labels.values())) > 150


def test_license_in_long_texts(spark):
    """Texts beyond one pass of the scan, with notices at both ends."""
    long = "Released under the MIT License " + "some words in between " * 60_000 + "Licensed under CC BY-NC 4.0"
    table = spark.createDataFrame([(1, long), (2, "mit license"), (3, "the " * 400_000)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.first_word, r.n_words) for r in license_scan(table.coalesce(1)).collect()}
    assert got == {1: ("cc-by,cc-by-nc-4.0,mit", 240_007, 240_012), 2: ("mit", None, 2), 3: ("", None, 400_000)}


def test_license_empty(empty_docs):
    assert license_scan(empty_docs).count() == 0


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(1)
    expected = []
    for stream in range(3):
        sizes = rng.integers(0, 12, 30).tolist() + [0, 0, 40]
        expected += [(stream, i, n) for i, n in enumerate(sizes)]
        tokens = np.concatenate([np.append(rng.integers(0, 9, n), 9) for n in sizes] + [np.array([1, 2])]).astype("<u2")
        raw = tokens.tobytes()
        for k in range(0, len(raw), 50):
            (tmp_path / f"s{stream:06d}-{k // 50:06d}.bin").write_bytes(raw[k : k + 50])
    got = scan_tokens(spark, f"file://{tmp_path}", 9, block).collect()
    assert sorted(map(tuple, got)) == expected


def test_token_counts_match_the_tokenizer(docs, empty_docs):
    coder = byte_pairs(queries.TOKEN_RANKS)
    expected = Counter((r.doc_id, len(coder.encode_ordinary(r.text or ""))) for r in docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, token_counts(docs, queries.TOKEN_RANKS, queries.TOKEN_END).collect())) == expected
    long = docs.sparkSession.createDataFrame([(1, "word " * 400_000), (2, "x" * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(long, queries.TOKEN_RANKS, queries.TOKEN_END).collect()} == {r.doc_id: len(coder.encode_ordinary(r.text)) for r in long.collect()}
    assert token_counts(empty_docs, queries.TOKEN_RANKS, queries.TOKEN_END).count() == 0
