"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, whatever lines it crosses: for a template of L words
it is ``ceil(L / threshold)`` words long (shorter at the end of a text) and begins at a word
of the template. So a notice wrapped over lines is found, with some words put in, and a long
line can't meet a template by gathering its words from afar. Block and template are sets of
words; a block meets a template if it holds at least ``threshold`` of the template's words,
that is ``need`` of its ``size``. Every such block is found and reported.

Words that no template knows can't matter. One scan of the corpus keeps, of every text, the
template words it holds and its blocks of those words; the number of texts that hold each
word orders all words from rare to common, and then
- length: a block with fewer than ``need`` known words is left out, already by the scan;
- prefix: of a matching pair, the template's first ``size - need + 1`` words and the
  block's first ``n - need + 1`` words share one, so an equi-join on those finds every pair;
- position: words shared at places i and j leave at most min(i, j) + min(size - i, n - j)
  in common, which must reach ``need``;
and the pairs left are verified on the whole sets. Nothing that meets the threshold is lost.

Relatives among templates differ in a few words, so a block that meets one often meets the
others. What a block tells is settled on its ``tight`` part: from its first word to the first
place where the threshold is met and all words that tell the template from its relatives
(``must``) have come. If there is such a place, and none of the words that would make it a
relative (``barred``) stands before it, the block tells the template's label. Of overlapping blocks
that tell one label the one with the shortest tight part counts, then the one with the largest
containment, then the first; of those left that tell different labels on overlapping places
likewise, the first label in the end; a block that a better one overlaps gives no label.
So a word of a relative that comes after a notice changes nothing.

The templates bound everything that is broadcast or reaches the driver.

Defined cases: null and empty texts have no words and no labels (first and last word
null, score 0); a very long text is scanned whole, as a numpy pass of its own; equal blocks
at different places each count; of several blocks that tell one label the largest containment
is the score; rows of one doc_id with different texts are told apart; repeated rows are all
returned; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, Scan, chunks, join_checked, texts_of
from corvane.llm.decontaminate import doc_key
from corvane.session import written

THRESHOLD = 0.8
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
# The phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A notice, the words of it that tell it from its relatives, and words that make it one of them."""

    label: str
    text: str
    must: str
    barred: str = ""


# Notices by which well-known licenses are declared, and the words that tell them apart.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2", "1"),
    Template("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "apache 2", "1"),
    Template("apache-2.0", "SPDX-License-Identifier: Apache-2.0", "spdx apache 2"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution binary"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4", "nc nd sa"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative attribution 4", "noncommercial noderivatives sharealike"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4", "nc nd"),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative attribution sharealike 4", "noncommercial noderivatives"),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4", "nc sa"),
    Template("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative attribution noderivatives 4", "noncommercial sharealike"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4", "nd sa"),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative attribution noncommercial 4", "noderivatives sharealike"),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa 4", "nd"),
    Template("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative attribution noncommercial sharealike 4", "noderivatives"),
    Template("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd 4", "sa"),
    Template("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "creative attribution noncommercial noderivatives 4", "sharealike"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu general 2", "lesser affero 3"),
    Template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gnu general 2", "lesser affero 3"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general 3", "lesser affero 2"),
    Template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu general 3", "lesser affero 2"),
    Template("mit", "MIT License", "mit license"),
    Template("mit", "SPDX-License-Identifier: MIT", "spdx mit"),
    Template("mit", "Released under the MIT License", "mit"),
    Template("mit", "Licensed under the MIT License", "mit"),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "permission granted software restriction"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2", "1"),
    Template("public-domain", "This work has been released into the public domain", "public domain"),
)


def split_words(text: str) -> list[str]:
    """The words of a text, A to Z in lower case."""
    return [w for w in re.split(WORD_BREAK, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def needed(size: int, threshold: float) -> int:
    """The least overlap that meets the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


@dataclass(frozen=True)
class Rule:
    """A template as sets: distinct words, least overlap, words of a block, must and barred words."""

    label: str
    words: list[str]
    need: int
    span: int
    must: list[str]
    barred: list[str]


def rules(templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[Rule]:
    """The rule of each template; one without words is left out."""
    out = []
    for t in templates:
        words = split_words(t.text)
        if words:
            own = sorted(set(words))
            out.append(Rule(t.label, own, needed(len(own), threshold), math.ceil(len(words) / threshold - 1e-9), sorted(set(split_words(t.must))), sorted(set(split_words(t.barred)))))
    return out


class Finder:
    """What a task looks for: ids of the known words, the base phrases, and for each block length its words and least size."""

    def __init__(self, made: list[Rule], phrases: dict[str, str]) -> None:
        self.known = sorted({w for r in made for w in (*r.words, *r.barred)})
        every = sorted({*self.known, *(w for p in phrases for w in p.split())}, key=lambda w: (w not in self.known, w))
        self.ids = {w: i for i, w in enumerate(every)}
        raw = [w.encode() for w in every]
        ends = np.cumsum([len(w) for w in raw]) if raw else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = Scan(data, np.array([0, len(data)]), _BREAKS).hashes(ends - np.array([len(w) for w in raw], np.int64), ends) if raw else np.zeros(0, np.uint64)
        self.place = np.argsort(hashes)
        self.hashes = hashes[self.place]
        self.phrases = [(label, [self.ids[w] for w in phrase.split()]) for phrase, label in phrases.items()]
        self.spans: list[tuple[int, int, np.ndarray]] = []
        for span in sorted({r.span for r in made}):
            mask = np.zeros(len(every) + 1, bool)
            mask[[self.ids[w] for r in made if r.span == span for w in (*r.words, *r.barred)]] = True
            self.spans.append((span, min(r.need for r in made if r.span == span), mask))

    def word_ids(self, scan: Scan) -> np.ndarray:
        """The id of each word of a chunk, -1 for a word that isn't looked for."""
        words = scan.words()
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.place[at], -1)

    def base(self, scan: Scan, ids: np.ndarray) -> dict[str, np.ndarray | list]:
        """Per text: places of the base phrases, the first and last of them, and their labels."""
        n = len(scan.bounds) - 1
        count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[list[str]] = [[] for _ in range(n)]
        for label, phrase in self.phrases:
            stop = len(ids) - len(phrase) + 1
            if stop <= 0:
                continue
            fits = scan.doc[:stop] == scan.doc[len(phrase) - 1 :]
            for k, w in enumerate(phrase):
                fits &= ids[k : k + stop] == w
            at = np.flatnonzero(fits)
            doc = scan.doc[at]
            np.add.at(count, doc, 1)
            np.minimum.at(low, doc, at - scan.first[doc])
            np.maximum.at(high, doc, at - scan.first[doc])
            for d in np.unique(doc).tolist():
                labels[d].append(label)
        none = count == 0
        return {"n_base": pa.array(count), "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none), "base": pa.array([sorted(set(x)) for x in labels], pa.list_(pa.string()))}

    def blocks(self, scan: Scan, ids: np.ndarray) -> list[list[dict]]:
        """Per text its blocks with enough known words: block length, first place, and the known words with their places in it."""
        found: list[list[dict]] = [[] for _ in range(len(scan.bounds) - 1)]
        for span, need, mask in self.spans:
            at = np.flatnonzero(mask[ids])
            own, doc = ids[at], scan.doc[at]
            stop = np.searchsorted(at, np.minimum(at + span, scan.first[doc + 1]))
            for i in np.flatnonzero(stop - np.arange(len(at)) >= need).tolist():
                words = own[i : stop[i]]
                if len(set(words.tolist())) >= need:
                    found[doc[i]].append({"span": span, "start": int(at[i] - scan.first[doc[i]]), "places": at[i : stop[i]] - at[i], "words": words})
        return found


_BLOCKS = pa.list_(pa.struct([("span", pa.int32()), ("start", pa.int32()), ("places", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))]))
_SCANNED = "doc_id long, doc_key long, n_words long, n_base long, first_word long, last_word long, base array<string>, held array<int>, blocks array<struct<span: int, start: int, places: array<int>, words: array<int>>>"


def scanned(docs: DataFrame, finder: Finder) -> DataFrame:
    """One row for each row of ``docs``: base counts, the known words it holds, and its blocks; itself written."""
    shared = docs.sparkSession.sparkContext.broadcast(finder)  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n_known = len(own.known)
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            data = LOWER[data]
            for a, b, part, cut in chunks(data, bounds):
                scan = Scan(part, cut, _BREAKS)
                ids = own.word_ids(scan)
                at = np.flatnonzero((ids >= 0) & (ids < n_known))
                pairs = np.unique(scan.doc[at] * max(n_known, 1) + ids[at])
                first = np.searchsorted(pairs, np.arange(b - a + 1) * max(n_known, 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(first), pa.array((pairs % max(n_known, 1)).astype(np.int32)))
                made = {"doc_id": batch.column("doc_id").slice(a, b - a), "doc_key": batch.column("doc_key").slice(a, b - a), "n_words": pa.array(scan.n_words.astype(np.int64)), **own.base(scan, ids), "held": held, "blocks": pa.array(own.blocks(scan, ids), _BLOCKS)}
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return written(docs.select(F.col("doc_id").cast("long"), doc_key().alias("doc_key"), "text").mapInArrow(run, _SCANNED), "license-scan")


def tight(words: list[int], places: list[int], own: set[int], need: int, must: set[int], barred: set[int]) -> tuple[int, bool]:
    """Words from a block's first to where the threshold is met and ``must`` has come, and whether it tells the template; without such a place, to where the threshold is met."""
    seen: set[int] = set()
    met = 0
    for word, place in zip(words, places, strict=True):
        seen.add(word)
        if len(seen & own) >= need:
            met = met or place + 1
            if must <= seen:
                return place + 1, not seen & barred
    return met, False


def joined(scan: DataFrame, made: list[Rule], finder: Finder) -> DataFrame:
    """Every block of ``scan`` that meets a rule: ``doc_key, start, length, label, containment, tells``; ``length`` is of its tight part."""
    spark = scan.sparkSession
    counts = {r[0]: r[1] for r in scan.select(F.explode("held").alias("word")).groupBy("word").count().collect()}  # one row a known word
    order = {i: rank for rank, i in enumerate(sorted((finder.ids[w] for w in finder.known), key=lambda i: (counts.get(i, 0), i)))}
    ranks = F.create_map(*(F.lit(x) for pair in order.items() for x in pair)) if order else F.create_map(F.lit(0), F.lit(0))
    rank_of = lambda words: sorted(order[finder.ids[w]] for w in words)
    prefix, whole = [], []
    for k, r in enumerate(made):
        own = rank_of(r.words)
        prefix += [(k, r.span, w, i, len(own), r.need) for i, w in enumerate(own[: len(own) - r.need + 1])]
        whole.append((k, r.label, own))
    prefixes = spark.createDataFrame(prefix, "rule int, span int, rank int, i int, size int, need int")
    wholes = spark.createDataFrame(whole, "rule int, label string, own array<int>")
    blocks = scan.where("size(blocks) > 0").select("doc_key", F.explode(F.array_distinct("blocks")).alias("b")).select("doc_key", "b.span", "b.start", "b.places", F.transform("b.words", lambda w: ranks[w]).alias("seq"))
    probe = blocks.withColumn("ranks", F.array_sort(F.array_distinct("seq"))).select("*", F.size("ranks").alias("n"), F.posexplode("ranks").alias("j", "rank"))
    pairs = join_checked(probe, prefixes, ["span", "rank"], "inner").where("n >= need and j <= n - need and least(i, j) + least(size - i, n - j) >= need")
    overlap = F.size(F.array_intersect("ranks", "own"))
    candidates = pairs.select("doc_key", "start", "places", "seq", "ranks", "rule", "size", "need").distinct()
    verified = join_checked(candidates, wholes, "rule", "inner").where((overlap >= F.col("need")) & F.array_contains("own", F.col("seq")[0]))
    verified = verified.select("doc_key", "start", "rule", "label", F.round(overlap / F.col("size"), 6).alias("containment"), "seq", "places")
    sets = [(set(rank_of(r.words)), r.need, set(rank_of(r.must)), set(rank_of(r.barred))) for r in made]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [tight(w, p, *sets[k]) for k, w, p in zip(*(batch.column(c).to_pylist() for c in ("rule", "seq", "places")), strict=True)]
            made = [batch.column(c) for c in ("doc_key", "start", "label", "containment")] + [pa.array([t[0] for t in told], pa.int32()), pa.array([t[1] for t in told], pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_key", "start", "label", "containment", "length", "tells"])

    return verified.mapInArrow(tell, "doc_key long, start int, label string, containment double, length int, tells boolean")


def matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block that meets a template: ``doc_key``, its first word's place ``start``, ``label``, ``containment``, ``length`` of its tight part and whether it ``tells`` the label."""
    made = rules(templates, threshold)
    finder = Finder(made, {})
    return joined(scanned(docs, finder), made, finder)


def labelled(blocks: DataFrame, made: list[Rule]) -> DataFrame:
    """The blocks of ``joined`` that tell a label, the best ones of each label, that aren't overlapped by a better one of another label.

    Blocks are short, so only those of neighbouring cells of a text are compared.
    """
    cell = max((r.span for r in made), default=1)
    own = ["doc_key", "start", "length", "label", "containment"]

    def unbeaten(told: DataFrame, same: bool) -> DataFrame:
        near = told.select("doc_key", F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("cell"), *(F.col(c).alias(f"a_{c}") for c in own[1:]))
        last = "start" if same else "label"
        better = F.struct("a_length", -F.col("a_containment"), f"a_{last}") < F.struct("length", -F.col("containment"), last)
        meets = (F.col("a_start") < F.col("start") + F.col("length")) & (F.col("start") < F.col("a_start") + F.col("a_length"))
        beaten = told.join(near, ["doc_key", "cell"]).where(meets & better & ((F.col("a_label") == F.col("label")) == F.lit(same))).select(*own).distinct()
        return told.join(beaten, own, "left_anti")

    told = written(blocks.where("tells").select(*own).distinct().withColumn("cell", F.floor(F.col("start") / cell)), "license-blocks")
    return unbeaten(written(unbeaten(told, True), "license-best"), False).select(*own)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each row of ``docs``: counts and places of the base phrases, labels of both ways, and a score.

    The score is 1 where a base phrase stands, otherwise the best containment of a block
    that gives a label, otherwise 0.
    """
    made = rules(templates, threshold)
    finder = Finder(made, phrases)
    scan = scanned(docs, finder)
    found = written(labelled(joined(scan, made, finder), made).groupBy("doc_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")), "licenses")
    rows = join_checked(scan.drop("held", "blocks"), found, "doc_key")
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
