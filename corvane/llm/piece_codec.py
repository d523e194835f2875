"""SentencePiece encoding with seeded merge-dropout, and its decoding.

The pieces and their scores come from a given model file. Encoding works on the merge
agenda: of all adjacent pairs whose join is a piece, the best-scored (then leftmost) is
merged, until none is left. With dropout each candidate (its place and its two pieces) is
looked up in a keyed hash, and skipped for good if the hash falls below the rate; so a
text gets one of many segmentations, the same one for the same seed on every run. Rate 0
gives the model's own segmentation.

Pieces never run across the start of a run of spaces, so texts fall into short units.
All units of a chunk go through their agendas in step, as numpy arrays: one round merges
the best candidate of every unit that has one left. A unit of more than ``LONG`` characters
(text without spaces) goes through its agenda alone, with a heap and a linked list, so its
cost grows with n log n. The key of a unit is a 64-bit hash of
seed, doc_id and the unit's place, so each occurrence of a word has skips of its own.
Equal units of a chunk are worked out once only where no key matters, at rate 0, or where
a caller bounds the keys to ``variants`` values.

Batches of ids leave a task in chunks of about half a megabyte of text, and are decoded in chunks.

Decoding joins the pieces' bytes again, so encoding loses nothing: a character without a
piece becomes byte pieces, and so does U+2581, which would read as a space otherwise.

Defined cases: null and empty texts have no pieces (null ids stay null when decoded from
null); very long texts are whole chunks, very long words as above (about 5 seconds and 200 MB
a million characters); ties of score go to the leftmost pair; repeated rows encode alike; a null doc_id hashes as -1; an empty table gives no
rows; other columns aren't read, or are carried by name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scan, chunks, mix, texts_of

RATE = 0.1
SEED = 20240901
#: Bytes of units that go through their agendas at once; a longer unit is a run of its own.
RUN_BYTES = 1 << 18
#: Ids that are decoded at once; a longer row is a chunk of its own.
DECODE_IDS = 1 << 18
#: Characters beyond which a unit goes through its agenda alone.
LONG = 256
_NONE = np.int64(1) << 40
_SLOTS = 1 << 18


@dataclass
class Vocabulary:
    """Arrays of a model: symbols of characters, joins of pieces, bytes of pieces."""

    symbol: np.ndarray
    slots: np.ndarray
    slot_rank: np.ndarray
    slot_made: np.ndarray
    blob: np.ndarray
    place: np.ndarray
    byte_id: np.ndarray
    alone: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        """The arrays of the model at ``path`` (a local path of the driver; executors get the arrays)."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        normal = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        symbol = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                symbol[ord(p)] = i
        symbol[0x20], symbol[0x2581] = normal["▁"], -1
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("a piece holds a space after other characters; units can't be parted at spaces")
        scores = sorted({model.get_score(i) for i in normal.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        slots, slot_rank, slot_made = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int32)
        for p, i in normal.items():
            for k in range(1, len(p)):
                if (a := normal.get(p[:k])) is not None and (b := normal.get(p[k:])) is not None:
                    key = a << 20 | b
                    at = int(_slot(np.array([key]))[0])
                    while slots[at] >= 0:
                        at = (at + 1) % _SLOTS
                    slots[at], slot_rank[at], slot_made[at] = key, order[model.get_score(i)], i
        byte_id = np.zeros(256, np.int32)
        raw = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                byte_id[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            else:
                raw.append(p.replace("▁", " ").encode() if p in normal else b"")
        alone = np.zeros(256, bool)
        alone[[c for c in range(0x20) if not any(chr(c) in p for p in normal)]] = True
        return Vocabulary(symbol, slots, slot_rank, slot_made, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), byte_id, alone)

    def table(self) -> dict[int, tuple[int, int]]:
        """Rank and piece of each join by its key, made once a process."""
        if (found := getattr(self, "_table", None)) is None:
            held = np.flatnonzero(self.slots >= 0)
            found = self._table = dict(zip(self.slots[held].tolist(), zip(self.slot_rank[held].tolist(), self.slot_made[held].tolist(), strict=True), strict=True))
        return found

    def joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair's join; rank ``_NONE`` where there is none."""
        key = left.astype(np.int64) << 20 | right
        rank, made = np.full(len(key), _NONE), np.zeros(len(key), np.int32)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        at = _slot(key[ask])
        while len(ask):
            held = self.slots[at]
            hit = held == key[ask]
            rank[ask[hit]], made[ask[hit]] = self.slot_rank[at[hit]], self.slot_made[at[hit]]
            more = ~hit & (held >= 0)
            ask, at = ask[more], (at[more] + 1) % _SLOTS
        return rank, made


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def dropped(variant: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """Which candidates the keyed hash skips: ``variant`` is the unit's key, ``start`` the first character's place in it."""
    h = mix(variant ^ mix(start.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) ^ (left.astype(np.uint64) << np.uint64(32)) ^ right.astype(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


def unit_keys(seed: int, doc_id: np.ndarray, ordinal: np.ndarray, variants: int | None = None) -> np.ndarray:
    """The key of each unit: a hash of seed, doc_id and place, or one of ``variants`` values."""
    pick = mix(mix(doc_id.astype(np.uint64) ^ mix(np.uint64([seed]))) + ordinal.astype(np.uint64))
    if variants is not None:
        pick %= np.uint64(variants)
    return mix(pick + mix(np.uint64([seed ^ 0x5851F42D])))


_MASK = (1 << 64) - 1


def _mixed(h: int) -> int:
    """``mix`` of one integer."""
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _MASK
    return h ^ (h >> 31)


def _segment_alone(voc: Vocabulary, points: np.ndarray, key: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that the agenda of one long unit leaves, and the place of the first character of each."""
    n = len(points)
    symbols = voc.symbol[points]
    rank, made = voc.joins(symbols[:-1], symbols[1:])
    if rate > 0:
        some = np.flatnonzero(rank < _NONE)
        rank[some[dropped(np.uint64([key]), some, symbols[some], symbols[some + 1], rate)]] = _NONE
    known, bar, none = voc.table(), int(rate * 2.0**53), int(_NONE)
    live = np.flatnonzero(rank < _NONE)
    heap = ((rank[live] << 32) | live).tolist()
    heapify(heap)
    sym, after, before = array("i", symbols.astype(np.int32).tobytes()), array("q", np.arange(1, n + 1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())
    best, join = array("q", np.append(rank, none).tobytes()), array("i", np.append(made, 0).astype(np.int32).tobytes())
    while heap:
        top = heappop(heap)
        at = top & 0xFFFFFFFF
        if best[at] != top >> 32:
            continue
        gone = after[at]
        sym[at], best[gone], after[at] = join[at], none, after[gone]
        best[at] = none
        if after[at] < n:
            before[after[at]] = at
        for left in (before[at], at):
            right = after[left] if left >= 0 else n
            if right >= n:
                continue
            best[left] = none
            a, b = sym[left], sym[right]
            found = known.get(a << 20 | b) if a >= 0 and b >= 0 else None
            if found is None:
                continue
            if bar and _mixed(key ^ _mixed(((left * 0xA24BAED4963EE407) & _MASK) ^ (a << 32) ^ b)) >> 11 < bar:
                continue
            best[left], join[left] = found
            heappush(heap, found[0] << 32 | left)
    kept, at = array("q"), 0
    while at < n:
        kept.append(at)
        at = after[at]
    origin = np.frombuffer(kept, np.int64)
    return np.frombuffer(sym, np.int32)[origin], origin


def _segment(voc: Vocabulary, points: np.ndarray, first: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every unit, and where each unit's ids begin; ``points`` are the units' code points."""
    origin = np.arange(len(points))
    unit = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, sym = origin - first[unit], voc.symbol[points]

    def ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = voc.joins(sym[a], sym[a + 1])
        if rate > 0:
            some = np.flatnonzero(rank < _NONE)
            off = dropped(key[unit[a[some]]], start[a[some]], sym[a[some]], sym[a[some] + 1], rate)
            rank[some[off]] = _NONE
        return rank, made

    rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    far = np.flatnonzero(np.diff(first) > LONG)
    for u in far.tolist():
        left, at = _segment_alone(voc, points[first[u] : first[u + 1]], int(key[u]), rate)
        done.append((at + first[u], left))
    if len(far):
        short = np.flatnonzero(np.isin(unit, far, invert=True))
        sym, unit, start, origin, rank, made = (x[short] for x in (sym, unit, start, origin, rank, made))
    inner = np.flatnonzero(unit[:-1] == unit[1:])
    rank[inner], made[inner] = ranked(inner)
    while len(sym):
        lead = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        size = np.diff(np.append(lead, len(sym)))
        best = np.minimum.reduceat((rank << 22) | np.arange(len(sym)), lead) if len(sym) < 1 << 22 else _far_best(rank, lead, size)
        live = (best >> 22) < _NONE if len(sym) < 1 << 22 else best >= 0
        keep = np.repeat(live, size)
        done.append((origin[~keep], sym[~keep]))
        at = best[live] & ((1 << 22) - 1) if len(sym) < 1 << 22 else best[live]
        sym[at] = made[at]
        rank[at] = _NONE
        has_next = np.zeros(len(sym), bool)
        has_next[at] = (at + 2 < len(sym)) & (unit[np.minimum(at + 2, len(sym) - 1)] == unit[at])
        has_before = at[(at > 0) & (unit[np.maximum(at, 1) - 1] == unit[at])]
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        after, before = place[np.flatnonzero(has_next)], place[has_before] - 1
        sym, unit, start, origin, rank, made = (x[keep] for x in (sym, unit, start, origin, rank, made))
        touched = np.concatenate([after, before])
        if len(touched):
            rank[touched], made[touched] = ranked(touched)
    origin, sym = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(origin, kind="stable")
    origin, sym = origin[order], sym[order]
    point = points[origin].astype(np.int64)
    width = np.where(sym >= 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
    ids = np.repeat(sym, width)
    unknown = np.flatnonzero(sym < 0)
    if len(unknown):
        into = np.cumsum(width) - width
        wide, cp = width[unknown], point[unknown]
        for k in range(4):
            row = wide > k
            lead_mark = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide]
            octet = np.where(k == 0, np.where(wide == 1, cp, lead_mark | (cp >> (6 * (wide - 1)))), 0x80 | ((cp >> np.maximum(6 * (wide - 1 - k), 0)) & 0x3F))
            ids[into[unknown[row]] + k] = voc.byte_id[octet[row]]
    total = np.concatenate([[0], np.cumsum(width)])
    return ids, total[np.searchsorted(origin, first)]


def _far_best(rank: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of each unit's best candidate (-1: none), where places don't fit beside ranks in one integer."""
    least = np.minimum.reduceat(rank, lead)
    hit = np.flatnonzero(rank == np.repeat(least, size))
    owner = np.repeat(np.arange(len(lead)), size)[hit]
    _, at = np.unique(owner, return_index=True)
    return np.where(least < _NONE, hit[at], -1)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    out = np.arange(int(size.sum()))
    return out - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def encode_texts(voc: Vocabulary, data: np.ndarray, bounds: np.ndarray, doc_id: np.ndarray, rate: float, seed: int, variants: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every text of a chunk, and where each text's ids begin."""
    size = np.diff(bounds)
    held = size > 0
    cut = np.concatenate([[0], np.cumsum(size + held)])
    led = np.full(cut[-1], 0x20, np.uint8)
    body = np.ones(cut[-1], bool)
    body[cut[:-1][held]] = False
    led[body] = data
    scan = Scan(led, cut, np.zeros(256, bool))
    space, alone = led == 0x20, voc.alone[led]
    opens = np.ones(len(led), bool)
    opens[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    opens[cut[:-1][held]] = True
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(led)) if len(begin) else begin
    text = np.searchsorted(cut, begin, "right") - 1
    ordinal = np.arange(len(begin)) - np.searchsorted(begin, cut[:-1])[text]
    key = unit_keys(seed, doc_id[text], ordinal, variants)
    if rate > 0 and variants is None:
        sample = same = np.arange(len(begin))
    else:
        alike = scan.hashes(begin, end)
        _, sample, same = np.unique(mix(alike ^ key) if rate > 0 else alike, return_index=True, return_inverse=True)
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a, b, octets, cuts in chunks(led[_spans(begin[sample], (end - begin)[sample])], np.concatenate([[0], np.cumsum((end - begin)[sample])]), RUN_BYTES):
        starts = (octets & 0xC0) != 0x80
        points = np.frombuffer(octets.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(starts)])[cuts]
        found, at = _segment(voc, points, first, key[sample[a:b]], rate)
        parts.append(found)
        sizes.append(np.diff(at))
    ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    n = np.diff(at)[same]
    out = ids[_spans(at[:-1][same], n)]
    total = np.concatenate([[0], np.cumsum(n)])
    return out.astype(np.int32), total[np.searchsorted(begin, cut)]


def decode_ids(voc: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The text of each run of ids."""
    size = np.diff(voc.place)[ids]
    octets = voc.blob[_spans(voc.place[:-1][ids], size)].tobytes()
    at = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
    return [octets[a + 1 : b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def encoded(docs: DataFrame, voc: Vocabulary, rate: float = RATE, seed: int = SEED, variants: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``carry`` and ``piece_ids`` of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(voc)  # as large as the model file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            doc = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, part, cut in chunks(data, bounds):
                ids, at = encode_texts(own, part, cut, doc[a:b], rate, seed, variants)
                made = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", *carry)), made], names=["doc_id", *carry, "piece_ids"])

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in carry), "piece_ids array<int>"])
    return docs.select(F.col("doc_id").cast("long"), "text", *(c for c in carry if c != "text")).mapInArrow(run, schema)


def decoded(rows: DataFrame, voc: Vocabulary, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``carry`` and ``decoded``, the text of ``piece_ids``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column("piece_ids")
            bounds, gone = column.offsets.to_numpy().astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)
            values = column.values.to_numpy()[bounds[0] : bounds[-1]]
            for a, b, part, cut in chunks(values, bounds - bounds[0], DECODE_IDS):
                texts = [None if g else t for g, t in zip(gone[a:b], decode_ids(own, part, cut), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in carry), pa.array(texts, pa.string())], names=[*carry, "decoded"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "decoded string"])
    return rows.select("piece_ids", *(c for c in carry if c != "piece_ids")).mapInArrow(run, schema)
