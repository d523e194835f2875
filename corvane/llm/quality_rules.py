"""Quality rules: a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials are
counted over them: the raw one over every document, the target one over every trusted
document. A document's score is the mean over its n-grams of log(target / raw), so it
doesn't grow with length, and a document is kept if the score reaches a fixed threshold
and the base rules hold. Nothing is drawn at random.

Defined cases: a null or empty text has no words, so ``base_failed``; a very long text is
counted whole, as a numpy pass of its own; a score equal to the threshold is kept; repeated
rows are each counted and each scored; an empty corpus or target leaves the smoothed multinomials
equal, so every score is 0; a null doc_id is never trusted; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, Scan, base_counts, chunks, texts_of

#: Buckets of the hashed n-grams; also the bound of what reaches the driver.
N_BUCKETS = 1 << 14
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Neutral n-grams (ratio 1) that every document's mean includes, so that a dozen rare words don't sway it.
NEUTRAL_GRAMS = 10
#: Least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.075
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def _grams(scan: Scan, words: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every unigram and bigram."""
    pairs, at = scan.sequences(words, 2)
    return np.concatenate([words, pairs]) % np.uint64(n_buckets), np.concatenate([scan.doc, scan.doc[at]])


def bucket_counts(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS, few: int = BROADCAST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target n-gram counts by bucket, over all of ``docs`` and those whose doc_id is in ``trusted``.

    Each task sums its own texts into one histogram before the shuffle; the driver gets
    ``n_buckets`` rows whatever the size of the corpus. The trusted ids are broadcast to
    one scan while they number at most ``BROADCAST_ROWS`` (8 bytes each). Beyond that the
    raw counts come from a scan without a join, and only the trusted documents' texts are
    fetched by a semi-join, before whose shuffle Spark drops most others by a Bloom filter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            good = batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False)
            for a, b, part, cut in chunks(data, bounds):
                scan = Scan(part, cut)
                gram, doc = _grams(scan, scan.words(), n_buckets)
                gram = gram.astype(np.int64)
                raw += np.bincount(gram, minlength=n_buckets)
                target += np.bincount(gram[good[a:b][doc]], minlength=n_buckets)
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(raw[held]), pa.array(target[held])], names=["bucket", "raw", "target"])

    ids, texts, schema = trusted.select("doc_id").where("doc_id is not null").distinct(), docs.select("doc_id", "text"), "bucket long, raw long, target long"
    if ids.count() <= few:
        made = texts.join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "doc_id", "left").select("text", "trusted").mapInArrow(count, schema)
    else:
        raw_part = texts.select("text", F.lit(False).alias("trusted")).mapInArrow(count, schema)
        good = texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("text", F.lit(True).alias("trusted")).mapInArrow(count, schema)
        made = raw_part.union(good.select("bucket", F.lit(0).cast("long").alias("raw"), "target"))
    sums = made.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    got = sums.toArrow()  # columns, not a Python object for each bucket
    at = got["bucket"].to_numpy()
    raw[at], target[at] = got["raw"].to_numpy(), got["target"].to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target / raw) of each bucket, both smoothed; all zero without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    share = lambda c: (c + smoothing) / (c.sum() + smoothing * len(c))
    return np.log(share(target)) - np.log(share(raw))


def apply_rules(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts, ``llr`` and the verdict ``kept`` of every document, with the columns of ``carry``."""
    n_buckets = len(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            out: dict[str, list[np.ndarray]] = {}
            for _, _, part, cut in chunks(data, bounds):
                scan = Scan(part, cut)
                words = scan.words()
                gram, doc = _grams(scan, words, n_buckets)
                n = len(cut) - 1
                total = np.bincount(doc, ratios[gram.astype(np.int64)], n)
                llr = total / (np.bincount(doc, minlength=n) + NEUTRAL_GRAMS)
                found = {"n_words": scan.n_words.astype(np.int64), **base_counts(scan, words)}
                failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > max_repeat_percent * found["n_words"])
                for k, v in {**found, "base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr}.items():
                    out.setdefault(k, []).append(v)
            if out:
                made = {k: pa.array(np.concatenate(v)) for k, v in out.items()}
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), *made.values()], names=["doc_id", *carry, *made])

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in carry), *SCHEMA.split(", ")[1:]])
    texts = docs.select(F.col("doc_id").cast("long"), "text", *(c for c in carry if c != "text"))
    return texts.mapInArrow(score, schema)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, n_buckets: int = N_BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: counts, ``base_failed``, ``llr`` and ``kept``."""
    return apply_rules(docs, log_ratios(*bucket_counts(docs, trusted, n_buckets)), threshold, carry=carry)
