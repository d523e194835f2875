"""Fill-in-middle: every text is cut in units, parted in prefix, middle and suffix by keyed draws, and laid out anew.

A unit is a run of white space (space, U+0009 to U+000D) with the word after it; white space
at a text's end is a unit of its own. Texts are decoded to arrays of UTF-32 code points;
where a neighbour of another class follows (a word, then white space) a unit begins, so
``flatnonzero`` of one comparison gives all bounds of a chunk of texts, and the drawn ranks
index them. The slices between are encoded again. Draws are a hash of seed and doc_id, so a
lost task makes the same cuts again; nothing is shuffled.

Defined cases: a null text is empty; an empty text, one that holds a mark, and one that its
draw leaves out are plain (output equals text, no lengths); white space alone is one unit; a
null doc_id draws as the empty string; repeated rows give equal rows; ties don't arise (the
smaller draw ends the prefix, equal draws leave the middle empty); very long texts are cut
whole, each as a chunk of its own; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD_BREAK, chunks, texts_of

SEED = 42
#: Of a hundred texts, how many are cut, and of a hundred cut ones, how many have their suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Marks of prefix, suffix and middle; each one character between angle brackets.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_KINDS = np.array(["plain", "psm", "spm"])
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of a document: the first groups of eight digits of a keyed SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units begin among the code points of texts that lie one after another between ``edges``."""
    gap = WORD_BREAK[np.minimum(points, 255)]
    begins = np.zeros(len(points) + 1, bool)
    begins[1:-1] = gap[1:] & ~gap[:-1]
    begins[edges] = True
    return np.flatnonzero(begins[: len(points)])


def marked(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts hold a mark."""
    out = np.zeros(len(edges) - 1, bool)
    letters = [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]
    at = np.flatnonzero((points[:-2] == ord("<")) & (points[2:] == ord(">")) & np.isin(points[1:-1], letters))
    text = np.searchsorted(edges, at, "right") - 1
    out[text[at + 3 <= edges[text + 1]]] = True
    return out


def _cut(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, rate: int, suffix_first: int) -> list[pa.Array]:
    """Columns ``n, form, prefix_chars, middle_chars, output`` of a chunk of texts under draws ``h``."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    starts = unit_starts(points, edges)
    first = np.searchsorted(starts, edges)
    n = np.diff(first)
    ranks = np.sort(h[:2] % (n + 1), axis=0)
    bound = np.append(starts, len(points))
    cuts = np.where(ranks < n, bound[np.minimum(first[:-1] + ranks, len(starts))], edges[1:])
    plain = (n == 0) | marked(points, edges) | (h[2] % 100 >= rate)
    kind = np.where(plain, 0, np.where(h[3] % 100 < suffix_first, 2, 1))
    output = []
    for k, a, b, c, d in zip(kind.tolist(), edges[:-1].tolist(), *cuts.tolist(), edges[1:].tolist(), strict=True):
        piece = lambda x, y: points[x:y].tobytes().decode("utf-32-le")
        if k == 0:
            output.append(piece(a, d))
        elif k == 1:
            output.append(f"{PREFIX}{piece(a, b)}{SUFFIX}{piece(c, d)}{MIDDLE}{piece(b, c)}")
        else:
            output.append(f"{SUFFIX}{piece(c, d)}{PREFIX}{piece(a, b)}{MIDDLE}{piece(b, c)}")
    return [pa.array(n), pa.array(_KINDS[kind]), pa.array(cuts[0] - edges[:-1], mask=plain), pa.array(cuts[1] - cuts[0], mask=plain), pa.array(output, pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id``, units ``n``, ``form``, lengths of prefix and middle in code points, and ``output`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            h = np.stack([batch.column(f"h{k}").to_numpy() for k in range(4)])
            for a, b, part, cut in chunks(data, bounds):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *_cut(part, cut, h[:, a:b], rate, suffix_first)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    hashes = [h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))]
    return docs.select(F.col("doc_id").cast("long"), "text", *hashes).mapInArrow(run, _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; no piece holds a mark, so the marks part it one way only."""
    parts = F.split(output, f"<[{PREFIX[1]}{SUFFIX[1]}{MIDDLE[1]}]>", -1)
    join = lambda *order: F.concat(*(F.get(parts, F.lit(k)) for k in order))
    return F.when(form == "plain", output).when(form == "psm", join(1, 3, 2)).otherwise(join(2, 3, 1))
