"""Metrics: set and n-gram overlap, confusion rates, Dice, similarity, weighted reductions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.stems import stem
from corvane.functions.text import words


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def linear_score(features: Column, mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    """A linear model over features shifted and scaled."""
    lits = lambda v: F.array(*(F.lit(float(x)) for x in v))
    z = F.zip_with(F.zip_with(features, lits(mean), lambda x, m: x - m), lits(scale), lambda x, s: x / s)
    return dot(z, lits(weights)) + bias


def exact_match(prediction: Column, reference: Column) -> Column:
    """1.0 for equal strings, else 0.0."""
    return (F.coalesce(prediction, F.lit("")) == F.coalesce(reference, F.lit(""))).cast("double")


def set_scores(predicted: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; 0 where a denominator is 0."""
    p, r = F.array_distinct(predicted), F.array_distinct(reference)
    hit = F.size(F.array_intersect(p, r)).cast("double")
    precision = F.coalesce(F.try_divide(hit, F.size(p)), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hit, F.size(r)), F.lit(0.0))
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def unigram_overlap(prediction: Column, reference: Column) -> Column:
    """How many words two texts share, each counted as often as the rarer side has it."""
    p, r = words(prediction), words(reference)
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(r, w)))


def bleu1(prediction: Column, reference: Column) -> Column:
    """Sentence BLEU-1: clipped unigram precision with the brevity penalty; 0 for a blank prediction."""
    n, m = F.size(words(prediction)), F.size(words(reference))
    brevity = F.when(n >= m, F.lit(1.0)).otherwise(F.exp(1 - m / n))
    return F.when(n == 0, 0.0).otherwise(brevity * unigram_overlap(prediction, reference) / n)


def rouge1(prediction: Column, reference: Column) -> Column:
    """ROUGE-1 F of two texts."""
    n, m = F.size(words(prediction)), F.size(words(reference))
    return F.coalesce(F.try_divide(2.0 * unigram_overlap(prediction, reference), n + m), F.lit(0.0))


def _grams(w: list[str], n: int) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for i in range(len(w) - n + 1):
        out[tuple(w[i : i + n])] = out.get(tuple(w[i : i + n]), 0) + 1
    return out


def sentence_bleu(prediction: str | None, reference: str | None, order: int) -> float:
    """BLEU of one pair: geometric mean of clipped precisions, no smoothing, brevity penalty."""
    p, r = (prediction or "").split(), (reference or "").split()
    if not p:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        own, other = _grams(p, n), _grams(r, n)
        hit, total = sum(min(c, other.get(g, 0)) for g, c in own.items()), max(len(p) - n + 1, 0)
        if not hit:
            return 0.0
        logs += np.log(hit / total)
    return float(np.exp(logs / order) * (1.0 if len(p) >= len(r) else np.exp(1 - len(r) / len(p))))


def longest_common(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, one row of the table at a time."""
    if not a or not b:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(b))}
    other = np.array([codes[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        hit = np.concatenate([[0], row[:-1] + (other == codes.get(w, -1))])
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


def sentence_rouge_l(prediction: str | None, reference: str | None) -> float:
    """ROUGE-L F of one pair."""
    p, r = (prediction or "").split(), (reference or "").split()
    return 2 * longest_common(p, r) / (len(p) + len(r)) if p and r else 0.0


def bleu(order: int, prediction: Column, reference: Column) -> Column:
    """BLEU-``order`` over Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in batches:
            yield pd.Series([sentence_bleu(a, b, order) for a, b in zip(p, r, strict=True)], dtype="float64")

    return run(prediction, reference)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """ROUGE-L F over Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in batches:
            yield pd.Series([sentence_rouge_l(a, b) for a, b in zip(p, r, strict=True)], dtype="float64")

    return run(prediction, reference)


#: Partial alignments kept at each word; alignments of sentences rarely have more that differ.
BEAM = 64


def word_alignment(p: list[str], r: list[str], beam: int = BEAM) -> list[tuple[int, int]]:
    """Pairs of places: as many equal words as there can be, among the rest as many equal stems, with the fewest chunks, then the fewest crossings.

    Of a word, and of a stem, the number of pairs is the smaller of its two counts, so only
    *which* of its places are paired is open. That is settled from left to right: a place may
    be left out, or take a partner of another word, only while those numbers can still be
    reached; the ``beam`` best partial alignments are kept.
    """
    p_stem, r_stem = [stem(w) for w in p], [stem(w) for w in r]
    least = lambda a, b: {w: min(n, Counter(b)[w]) for w, n in Counter(a).items()}
    exact, total = least(p, r), least(p_stem, r_stem)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(r_stem):
        places.setdefault(w, []).append(j)
    to_come, stems_to_come, count = Counter(p), Counter(p_stem), Counter(r)
    states = [(0, 0, (), frozenset())]  # chunks, crossings, pairs, places taken
    for i, (word, root) in enumerate(zip(p, p_stem, strict=True)):
        to_come[word] -= 1
        stems_to_come[root] -= 1
        if not total[root]:
            continue
        grown = []
        for chunks, crossings, pairs, taken in states:
            same = Counter(p[a] for a, b in pairs if p[a] == r[b])
            of_root = sum(p_stem[a] == root for a, _ in pairs)
            used = Counter(r[b] for b in taken)
            may_skip = exact[word] - same[word] <= to_come[word]  # its own equal pairs can still be made by later places
            for j in places[root]:
                if j in taken or r[j] != word and (not may_skip or count[r[j]] - used[r[j]] - 1 < exact.get(r[j], 0) - same[r[j]]):
                    continue
                joined = bool(pairs) and pairs[-1] == (i - 1, j - 1)
                grown.append((chunks + (not joined), crossings + sum(b > j for b in taken), (*pairs, (i, j)), taken | {j}))
            if may_skip and total[root] - of_root <= stems_to_come[root]:
                grown.append((chunks, crossings, pairs, taken))
        states = sorted(grown, key=lambda s: s[:3])[:beam]
    return list(states[0][2])


def sentence_meteor(prediction: str | None, reference: str | None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR of one pair by exact words, then stems: weighted F times the penalty of its chunks.

    Each word is aligned once, as ``word_alignment`` has it; synonyms aren't used. 0 without a match.
    """
    p, r = (prediction or "").lower().split(), (reference or "").lower().split()
    pairs = word_alignment(p, r)
    if not pairs:
        return 0.0
    precision, recall = len(pairs) / len(p), len(pairs) / len(r)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    n_chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:], strict=False))
    return mean * (1 - gamma * (n_chunks / len(pairs)) ** beta)


def meteor(prediction: Column, reference: Column) -> Column:
    """``sentence_meteor`` over Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in batches:
            yield pd.Series([sentence_meteor(a, b) for a, b in zip(p, r, strict=True)], dtype="float64")

    return run(prediction, reference)


def bleu_expression(order: int, prediction: Column, reference: Column) -> Column:
    """BLEU-``order`` of a pair as an expression: for sentences, whose n-grams are few."""
    zero = F.lit(0.0)

    def score(p: Column, r: Column) -> Column:
        n, m = F.size(p), F.size(r)
        logs = zero
        for size in range(1, order + 1):
            grams = lambda w, size=size: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))).otherwise(F.expr("cast(array() as array<string>)"))
            hit = F.element_at(F.transform(F.array(F.struct(grams(p).alias("a"), grams(r).alias("b"))), lambda g: F.aggregate(F.array_distinct(g["a"]), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(g["a"], lambda y: y == x)), F.size(F.filter(g["b"], lambda y: y == x))))), 1)
            logs = logs + F.log(F.try_divide(hit.cast("double"), F.greatest(n - size + 1, F.lit(0))))
        return F.coalesce(F.exp(logs / order) * F.when(n >= m, F.lit(1.0)).otherwise(F.exp(1 - m / n)), zero)

    bound = F.transform(F.array(F.struct(words(prediction).alias("p"), words(reference).alias("r"))), lambda x: score(x["p"], x["r"]))
    return F.when(F.size(words(prediction)) > 0, F.element_at(bound, 1)).otherwise(zero)


def log_means(logs: Column) -> list[Column]:
    """The explode arguments of a map of logged values; group by ``key`` and average ``value``, missing keys don't count."""
    return [F.explode(logs).alias("key", "value")]


def subset_f1(counts: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """Macro and micro F1 of a subset of classes, by index."""
    return macro_micro(counts.where(F.col(index).isin(*wanted)))


def confusion(reference: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp and fn of 0/1 columns."""
    one = lambda c: F.sum(c.cast("long"))
    return [one((reference == 1) & (predicted == 1)).alias("tp"), one((reference == 0) & (predicted == 1)).alias("fp"), one((reference == 1) & (predicted == 0)).alias("fn")]


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn), 0 where nothing is counted."""
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def false_omission_rate(reference: Column, predicted: Column) -> Column:
    """An aggregate: of the rows predicted 0, the share whose reference is 1; null without any."""
    missed = F.sum(((reference == 1) & (predicted == 0)).cast("double"))
    return F.try_divide(missed, F.sum((predicted == 0).cast("double")))


def dice(shared: Column, predicted: Column, reference: Column) -> Column:
    """Dice of counted cells: 1 if both are empty, 0 if only one is."""
    return F.when((predicted == 0) & (reference == 0), 1.0).when((predicted == 0) | (reference == 0), 0.0).otherwise(2.0 * shared / (predicted + reference))


def dice_or_null(shared: Column, predicted: Column, reference: Column) -> Column:
    """Dice of counted cells, null if both are empty."""
    return F.try_divide(2.0 * shared, predicted + reference)


def finite_mean(x: Column) -> Column:
    """An aggregate: the mean of the finite values, times 100."""
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)) * 100


def reduced(loss: Column, weight: Column, how: str = "mean", factor: Column | None = None) -> Column:
    """An aggregate: a weighted sum, or its mean over rows or over ``factor``."""
    total = F.sum(loss * weight)
    return total if how == "sum" else F.try_divide(total, F.count("*") if factor is None else factor)


def focal_loss(p: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """The focal loss of a probability."""
    pt = F.when(target == 1, p).otherwise(1 - p)
    weight = F.when(target == 1, alpha).otherwise(1 - alpha)
    return -weight * F.pow(1 - pt, F.lit(gamma)) * F.log(F.greatest(pt, F.lit(1e-12)))


def soft_dice_loss(p: Column, target: Column, smooth: float = 1e-5) -> Column:
    """An aggregate: one less the soft Dice of probabilities and 0/1 targets."""
    return 1 - (2 * F.sum(p * target) + smooth) / (F.sum(p) + F.sum(target) + smooth)


def macro_micro(counts: DataFrame) -> DataFrame:
    """Macro and micro F1 of per-class tp, fp, fn rows."""
    return counts.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"))
