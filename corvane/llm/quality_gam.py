"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features in turn; each turn fits a
shallow tree to the residuals over that feature's bins and adds a share of it to the
feature's lookup table. When the single tables are done, the pairs that explain most of
what is left get two-way tables in the same way. A score is then the sum of one table
entry for each feature and pair, through a sigmoid: a few numpy look-ups and additions.

The fit takes at most ``MAX_ROWS`` labelled rows (the ones whose hashed doc_id is least),
so what reaches the driver is bounded; every document is scored in Spark tasks.

Defined cases: a null or empty text gets the features of no words and is scored like any
other; a very long text is scored whole, as a numpy pass of its own; of documents that share
a doc_id the one with the least features is learnt from; a score of 0.5 is predicted 1; a label that is null or not 0 or 1 is left out, several labels of one doc_id count
as their least; with no usable label, or only one kind, every score is that kind's share
(0.5 without any); a null doc_id is scored but never learnt from; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scan, base_counts, chunks, mix, texts_of

#: Labelled rows of a fit at most.
MAX_ROWS = 20_000
BINS = 48
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 60
MAX_PAIRS = 8
RATE = 0.15
#: Least weight (sum of p(1-p)) of a tree's leaf, and what is added to it.
LEAF, RIDGE = 2.0, 1.0

FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "stop_share", "dup_line_share", "repeat_share", "echo_share", "distinct_share", "short_share", "words_per_line", "high_byte_share", "odd_word_share")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER, _LETTER = _class(b"#*$%&|<>@=+~^_{}[]\\/"), _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _MARK, _STOP = _class(b"0123456789"), _class(b"!?"), _class(b".,;:")


def text_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text of a chunk."""
    scan = Scan(data, bounds)
    words = scan.words()
    base = base_counts(scan, words)
    n = len(bounds) - 1
    n_words, size = scan.n_words.astype(float), np.diff(bounds).astype(float)
    share = lambda part, whole: part / np.maximum(whole, 1)
    letters = scan.per_text(_LETTER[data])
    lines = scan.per_text(data == 0x0A) + 1
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (scan.doc[1:] == scan.doc[:-1])
    _, first = np.unique(words ^ mix(scan.doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    width = scan.ends - scan.starts
    odd = np.concatenate([[0], np.cumsum(_SYMBOL[data] | _DIGIT[data] | _MARK[data])])
    columns = [
        np.log1p(n_words),
        share(base["word_chars"], n_words),
        share(scan.per_text(_SYMBOL[data]), size),
        share(scan.per_text(_UPPER[data]), letters),
        share(scan.per_text(_DIGIT[data]), size),
        share(scan.per_text(_MARK[data]), size),
        share(scan.per_text(_STOP[data]), n_words),
        share(base["n_dup_lines"], lines),
        share(base["n_repeat_words"], n_words),
        share(scan.per_text_words(same.astype(np.int64)), n_words),
        share(np.bincount(scan.doc[first], minlength=n), n_words),
        share(scan.per_text_words((width <= 1).astype(np.int64)), n_words),
        n_words / lines,
        share(scan.per_text(data >= 128), size),
        share(scan.per_text_words((odd[scan.ends] > odd[scan.starts]).astype(np.int64)), n_words),
    ]
    return np.stack(columns, axis=1)


def _batch_features(column: pa.Array) -> np.ndarray:
    data, bounds = texts_of(column)
    return np.concatenate([np.zeros((0, len(FEATURES))), *(text_features(part, cut) for _, _, part, cut in chunks(data, bounds))])


@dataclass
class Gam:
    """Bin edges, a table for each feature, and a table for each chosen pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, j], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _split(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0.0, 0
    rest_g, rest_h = grad.sum() - g, hess.sum() - h
    gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - grad.sum() ** 2 / (hess.sum() + RIDGE)
    gain = np.where((h < LEAF) | (rest_h < LEAF), 0.0, gain)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A step function over the bins with at most ``leaves`` steps, grown where the gain is largest."""
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        found = [(*_split(grad[a:b], hess[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + RIDGE)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """A depth-two tree over a grid: one cut of the rows, then one of the columns on each side."""
    best, out = 0.0, np.zeros(grad.shape)
    for cut in range(1, len(grad)):
        gain, made = 0.0, np.zeros(grad.shape)
        for rows in (slice(0, cut), slice(cut, None)):
            g, h = grad[rows].sum(0), hess[rows].sum(0)
            side, at = _split(g, h)
            gain += side + g.sum() ** 2 / (h.sum() + RIDGE)
            for columns in (slice(0, at), slice(at, None)) if side > 0 else (slice(None),):
                made[rows, columns] = g[columns].sum() / (h[columns].sum() + RIDGE)
        if gain > best + 1e-9:
            best, out = gain, made
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of rows ``x`` and 0/1 labels ``y``; the same rows always give the same model."""
    cuts = lambda column, n: np.unique(np.quantile(column, np.arange(1, n) / n)) if len(column) else np.zeros(0)
    model = Gam(edges=[cuts(x[:, j], BINS) for j in range(x.shape[1])], coarse=[cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y):
        return model
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, bins in enumerate(fine):
            p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size))
            model.tables[j] += step
            total += step[bins]
    wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    cell = lambda i, j: wide[i] * (len(model.coarse[j]) + 1) + wide[j]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        size = shape(i, j)[0] * shape(i, j)[1]
        return np.bincount(cell(i, j), y - p, size).reshape(shape(i, j)), np.bincount(cell(i, j), p * (1 - p), size).reshape(shape(i, j))

    gains = sorted(((_pair_tree(*grids(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros(shape(i, j))) for gain, i, j in gains[:MAX_PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _pair_tree(*grids(i, j))[1]
            table += step
            total = total + step.ravel()[cell(i, j)]
    return model


def usable_labels(labels: DataFrame) -> DataFrame:
    """One 0/1 ``quality`` for each labelled doc_id."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """The model of the documents in ``labels`` (``doc_id``, 0/1 ``quality``), of ``max_rows`` of them at most."""
    # labels without a document don't use up the bound; ids alone are shuffled for that
    present = labels.join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _batch_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # ``chosen`` has max_rows rows at most, and rows that share a doc_id become one before they leave Spark
    made = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, x array<double>")
    rows = made.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.quality", "r.x").toArrow()
    ids = rows["doc_id"].to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda k: (zlib.crc32(str(ids[k]).encode()), ids[k])), np.int64)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x[order], rows["quality"].to_numpy()[order].astype(float))


def scored(docs: DataFrame, model: Gam, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``carry`` and ``score`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(model.score(_batch_features(batch.column("text"))))], names=["doc_id", *carry, "score"])

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in carry), "score double"])
    return docs.select(F.col("doc_id").cast("long"), "text", *(c for c in carry if c != "text")).mapInArrow(run, schema)


def held_out():
    """Whether a row is kept from learning: crc32 of its doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``; held-out labels aren't learnt."""
    model = train(docs, usable_labels(labels).where(~held_out()))
    return scored(docs, model, carry).select("doc_id", *carry, held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
