"""Removal of passages that repeat across documents, found by sharded Aho-Corasick automata.

A word goes if one of the windows of ``window`` consecutive words that cover it also starts
in a document of a smaller id. The steps, each a Spark job over all documents:

1. Phrases. Of each window the ``phrase``-word sequence of the least hash is its phrase; equal
   windows choose equal phrases at the same place, and neighbours mostly share theirs, so a
   document has about one phrase in 22 words. A phrase with all windows that chose it spans
   a run of words. Phrases are counted over all documents, by hash, with the first document.
2. Confirmation. Of phrases that recur, spans are counted by hash: a span of a smaller
   document gives all its windows away at once. Only where one phrase stands in different
   spans, the windows of each span's first document are counted one by one. Phrases without
   a recurring span or window are dropped.
3. Automata. Confirmed phrases, as text cut from their first document, are dealt to shards by
   that document (copies of one document meet one shard), ``SHARD`` phrases on average; a
   longer document's phrases lie in several shards. Each shard's phrases make an automaton.
4. Streaming. Each document runs through the automata of the shards in which its own
   recurring phrases lie (no other can hold a phrase of a window of it); the automaton gives
   every place of every phrase, and the windows that chose a phrase there are looked up.
   A shard with many documents is dealt to as many tasks as its bytes need, each with the
   shard's phrases, so a group of copies isn't one task.
5. The words of all windows found are taken out in one scan of all documents.

What is shuffled is hashes, in proportion to the words over 22, and the texts of documents
that hold a recurring passage. Windows are told apart by two 64-bit hashes.

Defined cases: a null text is empty and keeps nothing; texts of fewer words than a window
keep all; a null doc_id comes after all others, and rows without one, or rows of one doc_id,
take nothing from each other; repeated rows give equal rows; equal hashes inside a window are
settled by the first place; very long texts are scanned whole; an empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import _POWERS, Scan, chunks, join_checked, mix, texts_of
from corvane.llm.decontaminate import doc_key
from corvane.session import written

#: Words of a window and of a phrase.
WINDOW, PHRASE = 50, 8
#: Phrases of a shard, and bytes of text of a task that streams documents through one; both on average.
SHARD, PART_BYTES = 8192, 4 << 20

_LAST = (1 << 63) - 1
_U = np.uint64


def _each(docs: DataFrame, one: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``one`` over every Arrow batch; what a batch took goes back to the system before the next comes, as workers live on from stage to stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from one(batch)
            del batch
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


class Passages:
    """The windows of a chunk of texts: ``start`` (first word) and ``chose`` (first word of its phrase) of each, and the runs that share a phrase."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, window: int, phrase: int) -> None:
        self.scan, self.window, self.phrase = Scan(data, bounds), window, phrase
        words = self.scan.words()
        n = len(words)
        up, self.down = _POWERS.of(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=self.sums[1:])
        self.start = self.chose = self.first = np.zeros(0, np.int64)
        if n >= window:
            value = self.hashes(np.arange(n - phrase + 1), phrase)
            place = np.arange(len(value))
            size, width = 1, window - phrase + 1
            while size < width:
                step = min(size, width - size)
                later = value[step:] < value[:-step]
                place = np.where(later, place[step:], place[:-step])
                value = np.where(later, value[step:], value[:-step])
                size += step
            doc = self.scan.doc
            self.start = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
            self.chose = place[self.start]
            change = np.ones(len(self.start), bool)
            change[1:] = self.chose[1:] != self.chose[:-1]
            self.first = np.flatnonzero(change)  # of each run of windows
        self.place = self.chose[self.first]
        self.phrases = self.hashes(self.place, phrase)
        self.run = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.start))))

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the word sequences of ``size`` words at ``at``."""
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def spans(self) -> np.ndarray:
        """Of each run of windows, a hash of its words and of its phrase's place in them."""
        begin = self.start[self.first]
        size = self.start[np.append(self.first[1:], len(self.start)) - 1] + self.window - begin if len(self.first) else begin
        return mix(self.hashes(begin, size) ^ (size * 0x100000 + self.place - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, one space between them and a line break between texts, and where each word begins (one more than words)."""
        scan = self.scan
        place = np.concatenate([[0], np.cumsum(scan.ends - scan.starts + 1)])
        out = np.full(place[-1], 0x20, np.uint8)
        mask = np.ones(place[-1], bool)
        mask[place[1:] - 1] = False
        out[mask] = scan.data[scan.inside]
        heads = scan.first[1:-1]
        out[place[heads[heads > 0]] - 1] = 0x0A
        return out, place


def _held(values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which values stand in any of the lists."""
    return np.isin(values.view(np.int64), lists.flatten().to_numpy(zero_copy_only=False))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def phrases_of(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``key, rank, size, phrase, span`` of every distinct phrase and span of each of ``docs(key, rank, text)``; ``size`` is the text's bytes."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = texts_of(batch.column("text"))
        key, rank = batch.column("key").to_numpy(), batch.column("rank").to_numpy()
        for a, _, part, cut in chunks(data, bounds):
            found = Passages(part, cut, window, phrase)
            text, spans = found.scan.doc[found.place], found.spans()
            order = np.lexsort((spans, found.phrases, text))
            same = np.zeros(len(order), bool)
            same[1:] = np.all([x[order][1:] == x[order][:-1] for x in (text, found.phrases, spans)], axis=0)
            once = order[~same]
            at = text[once]
            made = [pa.array(key[a + at]), pa.array(rank[a + at]), pa.array((cut[at + 1] - cut[at]).astype(np.int64)), _long(found.phrases[once]), _long(spans[once])]
            yield pa.RecordBatch.from_arrays(made, names=["key", "rank", "size", "phrase", "span"])

    return _each(docs, one, "key long, rank long, size long, phrase long, span long")


def evidence(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Of ``docs(rank, text, windows, phrases)``: ``phrase, h, rank`` of the windows that chose one of ``windows``, and ``phrase, words`` of ``phrases``."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = texts_of(batch.column("text"))
        rank = batch.column("rank").to_numpy()
        for a, b, part, cut in chunks(data, bounds):
            found = Passages(part, cut, window, phrase)
            which = np.flatnonzero(_held(found.phrases, batch.column("windows").slice(a, b - a))[found.run])
            start = found.start[which]
            h = found.hashes(start, window)
            _, once = np.unique(found.scan.doc[start].astype(np.uint64) * _U(0x9E3779B97F4A7C15) ^ h, return_index=True)
            yield pa.RecordBatch.from_arrays([_long(found.phrases[found.run[which[once]]]), _long(h[once]), pa.array(rank[a + found.scan.doc[start[once]]]), pa.nulls(len(once), pa.binary())], names=["phrase", "h", "rank", "words"])
            _, once = np.unique(found.phrases, return_index=True)
            once = once[_held(found.phrases[once], batch.column("phrases").slice(a, b - a))]
            text, place = found.joined()
            whole = text.tobytes()
            at = found.place[once]
            words = [whole[i:j] for i, j in zip(place[at].tolist(), (place[at + phrase] - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_long(found.phrases[once]), pa.nulls(len(once), pa.int64()), pa.nulls(len(once), pa.int64()), pa.array(words, pa.binary())], names=["phrase", "h", "rank", "words"])

    return _each(docs.select("rank", "text", "windows", "phrases"), one, "phrase long, h long, rank long, words binary")


class Known:
    """What recurs, by phrase and hash, with the least rank that has it."""

    def __init__(self, phrase: np.ndarray, h: np.ndarray, least: np.ndarray) -> None:
        order = np.argsort(h)
        self.phrase, self.h, self.least = phrase[order], h[order], least[order]

    def least_of(self, phrase: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The least rank of each, or the greatest long where it isn't known."""
        if not len(self.h):
            return np.full(len(h), _LAST)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.phrase[at] == phrase), self.least[at], _LAST)


def _streamed(docs: pa.Table, known: pa.Table, window: int, phrase: int) -> pa.Table:
    """Of a shard's documents, the words that an automaton of its phrases and the known spans and windows give away, as ranges."""
    names = ["key", "begins", "ends"]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for words in known["words"].drop_null().to_pylist():
        automaton.add_word(words.decode("latin-1"))  # bytes as characters: places are bytes
    automaton.make_automaton()
    least = Known(*(known.filter(pa.compute.is_valid(known["h"]))[c].to_numpy() for c in ("phrase", "h", "least")))
    made = [[], [], []]
    data, bounds = texts_of(docs["text"])
    key, rank = docs["key"].to_numpy(), docs["rank"].to_numpy()
    for a, b, part, cut in chunks(data, bounds) if len(automaton) else ():
        found = Passages(part, cut, window, phrase)
        text, place = found.joined()
        hits = np.array(list(automaton.iter(text.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
        at = np.searchsorted(place, hits[:, 0] - hits[:, 1] + 1)
        whole = (place[at] == hits[:, 0] - hits[:, 1] + 1) & (at + phrase < len(place))
        at = at[whole & (place[np.minimum(at + phrase, len(place) - 1)] - 2 == hits[:, 0])]
        stands = np.zeros(len(place), bool)
        stands[at] = True
        run = np.flatnonzero(stands[found.place])
        own = rank[a:b]
        doc = found.scan.doc[found.place]
        gone_runs = np.zeros(len(found.place), bool)
        gone_runs[run] = least.least_of(found.phrases[run].view(np.int64), found.spans()[run].view(np.int64)) < own[doc[run]]
        gone = gone_runs[found.run] if len(found.run) else np.zeros(0, bool)
        rest = np.flatnonzero(stands[found.chose] & ~gone)
        who = found.phrases[found.run[rest]].view(np.int64)
        gone[rest] = least.least_of(who, found.hashes(found.start[rest], window).view(np.int64)) < own[found.scan.doc[found.start[rest]]]
        start = found.start[gone]
        of, local = found.scan.doc[start], start - found.scan.first[found.scan.doc[start]]
        new = np.ones(len(start), bool)
        new[1:] = (of[1:] != of[:-1]) | (local[1:] > local[:-1] + window)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
        made[0].append(key[a + of[heads]])
        made[1].append(local[heads])
        made[2].append(local[tails] + window)
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *m])) for m in made], names=names)


def repeats_removed(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, one space between them) of every row."""
    base = docs.select(doc_key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"), "text")
    found = written(phrases_of(base, window, phrase), "phrases")
    counted = found.groupBy("phrase").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.min_by("key", "rank").alias("owner"), F.min("span").alias("low"), F.max("span").alias("high"))
    recurring = written(counted.where("first < last").select("phrase", "first", "owner", (F.col("low") != F.col("high")).alias("several")), "phrases-recurring")
    shards = max(1, -(-recurring.count() // shard))
    wide = written(recurring.groupBy("owner").agg(F.ceil(F.count("*") / shard).alias("ways")).where("ways > 1"), "phrase-owners")
    placed = join_checked(recurring, wide, "owner", "left").withColumn("shard", F.pmod(F.xxhash64("owner", F.pmod("phrase", F.coalesce("ways", F.lit(1).cast("long")))), F.lit(shards).cast("long")))
    placed = written(placed.drop("ways"), "phrases-placed")
    held = written(found.join(placed, "phrase"), "phrases-held")

    spans = written(held.groupBy("phrase", "span", "shard", "several").agg(F.min("rank").alias("least"), F.max("rank").alias("last")), "phrase-spans")
    leads = held.where("several").select("phrase", "span", "rank", "key").join(spans.where("several").select("phrase", "span", "least"), ["phrase", "span"]).where("rank = least")
    asked = leads.select("key", F.col("phrase").alias("window"), F.lit(None).cast("long").alias("cut")).union(placed.select(F.col("owner").alias("key"), F.lit(None).cast("long"), "phrase"))
    asked = written(asked.groupBy("key").agg(F.collect_set("window").alias("windows"), F.collect_set("cut").alias("phrases")), "phrases-asked")
    seen = written(evidence(join_checked(base, asked, "key", "inner"), window, phrase), "phrase-evidence")
    windows = seen.where("h is not null").groupBy("phrase", "h").agg(F.min("rank").alias("least"), F.max("rank").alias("last")).where("least < last")
    where = placed.select("phrase", "shard")
    confirmed = windows.join(where, "phrase").select("shard", "phrase", "h", "least").union(spans.where("least < last").select("shard", "phrase", F.col("span").alias("h"), "least"))
    confirmed = written(confirmed, "phrases-confirmed")
    sure = written(confirmed.select("phrase").distinct(), "phrases-sure")
    texts = seen.where("words is not null").dropDuplicates(["phrase"]).join(sure, "phrase", "left_semi").join(where, "phrase")
    known = confirmed.withColumn("words", F.lit(None).cast("binary")).unionByName(texts.select("shard", "phrase", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("least"), "words"))

    visits = written(held.where("rank > first").join(sure, "phrase", "left_semi").select("key", "shard", "size").distinct(), "phrase-visits")
    parts = written(visits.groupBy("shard").agg(F.ceil(F.sum("size") / part_bytes).alias("parts")), "phrase-parts")
    routes = written(join_checked(visits, parts, "shard", "inner").groupBy("key").agg(F.collect_list(F.struct("shard", F.pmod(F.xxhash64("key"), F.greatest("parts", F.lit(1).cast("long"))).alias("part"))).alias("to")), "phrase-routes")
    again = written(base.groupBy("key").count().where("count > 1").select("key"), "phrase-repeats")
    bound = join_checked(base, routes, "key", "inner")
    if not again.isEmpty():
        bound = join_checked(bound, again, "key", "left_anti").union(join_checked(bound, again, "key", "left_semi").dropDuplicates(["key"]))
    streams = bound.select("key", "rank", "text", F.explode("to").alias("at")).select("at.*", "key", "rank", "text")
    each = join_checked(known, parts, "shard", "inner").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts") - 1, F.lit(0).cast("long"))))).drop("parts")
    ranges = streams.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInArrow(lambda left, right: _streamed(left, right, window, phrase), "key long, begins long, ends long")
    gone = written(ranges.groupBy("key").agg(F.collect_list("begins").alias("begins"), F.collect_list("ends").alias("ends")), "phrase-ranges")
    return _without(join_checked(docs.select(doc_key().alias("key"), F.col("doc_id").cast("long"), "text"), gone, "key", "left"))


def _without(docs: DataFrame) -> DataFrame:
    """Of ``docs(doc_id, text, begins, ends)``, ``doc_id, n_words, n_removed, kept`` without the words in the ranges."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = texts_of(batch.column("text"))
        for a, b, part, cut in chunks(data, bounds):
            scan = Scan(part, cut)
            n = len(scan.starts)
            cover = np.zeros(n + 1, np.int64)
            for name, sign in (("begins", 1), ("ends", -1)):
                lists = batch.column(name).slice(a, b - a)
                text = np.repeat(np.arange(b - a), np.diff(np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))))
                np.add.at(cover, scan.first[text] + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sign)
            stay = np.cumsum(cover[:-1]) == 0
            size = np.where(stay, scan.ends - scan.starts + 1, 0)
            place = np.concatenate([[0], np.cumsum(size)])
            out = np.full(place[-1], 0x20, np.uint8)
            mask = np.ones(place[-1], bool)
            mask[place[1:][stay] - 1] = False
            edge = np.zeros(len(part) + 1, np.int64)
            edge[scan.starts[stay]] += 1
            edge[scan.ends[stay]] -= 1
            out[mask] = part[np.cumsum(edge[:-1]) > 0]
            begin, end = place[scan.first[:-1]], place[scan.first[1:]]
            whole = out.tobytes()
            kept = [whole[i : max(i, j - 1)] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            removed = scan.n_words - scan.per_text_words(stay.astype(np.int64))
            made = [batch.column("doc_id").slice(a, b - a), pa.array(scan.n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_words", "n_removed", "kept"])

    return _each(docs.select("doc_id", "text", "begins", "ends"), one, "doc_id long, n_words long, n_removed long, kept string")
