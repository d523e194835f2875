"""What the operators share: size-checked joins, and vectorised scans of UTF-8 text.

Arrow batches are bounded in bytes by Spark itself (``spark.sql.execution.arrow.maxBytesPerBatch``,
64 MB unless set), so batches of long texts hold few rows; no operator changes the session.
Within a batch, texts go through numpy in chunks of about ``CHUNK_BYTES``.

A scan works on the bytes of many texts at once: numpy finds separators, word bounds and
line bounds, and prefix sums of a keyed polynomial give each word, line or word sequence
a 64-bit hash without a Python loop. Equal bytes always get equal hashes; different ones
collide with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at once; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 19
#: Rows and bytes (as JSON text) that a broadcast side may have at most; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)
_RADIX_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_KEYS = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: Bytes that part words: space and U+0009 to U+000D.
WORD_BREAK = np.zeros(256, bool)
WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True
#: A to Z in lower case, any other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def join_checked(left: DataFrame, side: DataFrame, on: list[str] | str, how: str = "left", limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``left`` joined to narrow ``side``, which is broadcast only if a count shows at most ``limit`` rows and ``limit_bytes`` bytes.

    Beyond the limits both are shuffled by the key, and Spark splits skewed partitions. The
    count reads ``side`` once more, so a side that costs much to make is written first.
    """
    rows, size = side.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return left.join(F.broadcast(side) if rows <= limit and size <= limit_bytes else side.hint("shuffle_hash"), on, how)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more than there are texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(data: np.ndarray, bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first text, end, bytes, bounds."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end
    pa.default_memory_pool().release_unused()  # workers live on from stage to stage


class Powers:
    """Powers of the hash radix and of its inverse, as many as the longest chunk so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, CHUNK_BYTES + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, r, np.uint64)])) for r in (_RADIX, _RADIX_INVERSE))
        return self.up, self.down


_POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Scan:
    """Words of a chunk of texts: ``starts``, ``ends`` (bytes), ``doc`` of each word, ``first`` word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = WORD_BREAK) -> None:
        self.data, self.bounds, n = data, bounds, len(data)
        self.inside = ~breaks[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, self.inside
        held = np.append(self.inside, False)
        self.starts = np.flatnonzero(held & (~before | edge))
        self.ends = np.flatnonzero(before & (~held | edge))
        self.first = np.searchsorted(self.starts, bounds)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.n_words)
        self._sums: np.ndarray | None = None

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text ``mask`` holds."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of each word over each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each start to its end."""
        up, down = _POWERS.of(len(self.data))
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_KEYS[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def sequences(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words within one text, and the first word of each."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = h * _RADIX + words[at + k]
        return mix(h), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def base_counts(scan: Scan, words: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: word_chars, n_symbols, n_dup_lines and n_repeat_words, each int64."""
    data, bounds = scan.data, scan.bounds
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    window, at = scan.sequences(words, 5)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        hit = at[repeated(window ^ mix(scan.doc[at].astype(np.uint64) + _U(1)))]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 5, -1)
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 0x0A) if len(line_start) else line_end[:0]
    inside = np.concatenate([[0], np.cumsum(scan.inside)])
    kept = inside[line_end] > inside[line_start] if len(line_start) else np.zeros(0, bool)
    line_start, line_end = line_start[kept], line_end[kept]
    line_doc = np.searchsorted(bounds, line_start, "right") - 1
    key = np.stack([line_doc.astype(np.uint64), scan.hashes(line_start, line_end)]) if len(line_start) else np.zeros((2, 0), np.uint64)
    order = np.lexsort(key[::-1])
    same = np.all(key[:, order][:, 1:] == key[:, order][:, :-1], axis=0)
    return {
        "word_chars": scan.per_text(scan.inside & ((data & 0xC0) != 0x80)),
        "n_symbols": scan.per_text(symbol[data]),
        "n_dup_lines": np.bincount(line_doc[order][1:][same], minlength=len(bounds) - 1).astype(np.int64),
        "n_repeat_words": scan.per_text_words((np.cumsum(covered[:-1]) > 0).astype(np.int64)),
    }
