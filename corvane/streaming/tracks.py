"""Track lifecycle over frames: one transition, run in batch, in stream, and as pure window expressions.

In frame order a slot's score of ``active`` or more keeps its track alive; an unborn slot
that is active gets the next id of its sequence; a born slot that isn't active ages by
one, and after ``tolerance`` such frames its id goes back to -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIVE, TOLERANCE = 0.6, 10
UNBORN = -1
#: Frames of a sequence, and rows that come in, which are in memory together.
SPAN, ROWS_KEPT = 1 << 14, 1 << 18


def advance(state: tuple[int, int, int], score: float, active: float = ACTIVE, tolerance: int = TOLERANCE) -> tuple[int, int, int]:
    """(id, age, next id) of a slot after one frame."""
    ident, age, fresh = state
    if score >= active:
        age = 0
        if ident == UNBORN:
            ident, fresh = fresh, fresh + 1
    elif ident != UNBORN:
        age += 1
        if age >= tolerance:
            ident = UNBORN
    return ident, age, fresh


def track_ids(obs: DataFrame, slot: list[str], frame: str, score: str, active: float = ACTIVE, tolerance: int = TOLERANCE) -> DataFrame:
    """``obs`` with ``track``, ids counted from 0 in each slot, by window expressions alone.

    Each slot is its own sequence. A birth is an active frame with no active one among the
    ``tolerance`` frames before it, and a track lives until that many frames have passed.
    """
    w = Window.partitionBy(*slot).orderBy(frame)
    place = F.row_number().over(w)
    seen = F.when(F.col(score) >= active, F.col("__n"))
    out = obs.withColumn("__n", place).withColumns({"__last": F.max(seen).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__before": F.max(seen).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    birth = (F.col(score) >= active) & (F.col("__before").isNull() | (F.col("__n") - F.col("__before") - 1 >= tolerance))
    out = out.withColumn("__births", F.sum(birth.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dead = F.col("__last").isNull() | (F.col("__n") - F.col("__last") >= tolerance)
    return out.withColumn("track", F.when(dead, F.lit(UNBORN).cast("long")).otherwise(F.col("__births") - 1)).drop("__n", "__last", "__before", "__births")


def track_sequences(obs: DataFrame, seq: str = "seq", frame: str = "frame", slot: str = "slot", score: str = "score", active: float = ACTIVE, tolerance: int = TOLERANCE) -> DataFrame:
    """Tracks of whole sequences, whose slots share one id counter that starts at 0: ``seq, frame, slot, track``.

    A slot's life doesn't depend on the others, only the number it gets does: births of a
    sequence are numbered in order of frame, then slot. So slots are worked out alone, and
    only births meet in one window.
    """
    own = track_ids(obs.select(seq, slot, frame, score), [seq, slot], frame, score, active, tolerance).withColumnRenamed("track", "__own")
    born = own.where(F.col("__own") >= 0).groupBy(seq, slot, "__own").agg(F.min(frame).alias("__born"))
    numbered = born.withColumn("track", F.row_number().over(Window.partitionBy(seq).orderBy("__born", slot)).cast("long") - 1).drop("__born")
    return own.join(numbered, [seq, slot, "__own"], "left").select(seq, frame, slot, F.coalesce("track", F.lit(UNBORN).cast("long")).alias("track"))


def stream_tracks(obs: DataFrame, slot: str, frame: str, score: str, active: float = ACTIVE, tolerance: int = TOLERANCE) -> DataFrame:
    """The same transition over a stream keyed by slot: a row for each observation, with its track.

    Rows of one micro-batch are taken in frame order; state is (id, age, next id) and the
    last frame taken. A row older than that came too late and is left out, so the result
    doesn't depend on how the stream is cut, as long as each slot's frames arrive in order.
    """
    types = dict(obs.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *held, last = state.get if state.exists else (UNBORN, 0, 0, None)
        rows = pd.concat(list(batches)).sort_values(frame)
        if last is not None:
            rows = rows[rows[frame] > last]
        tracks = []
        for v in rows[score].tolist():
            held = advance(tuple(held), v, active, tolerance)
            tracks.append(held[0])
        if len(rows):
            state.update((*held, int(rows[frame].iloc[-1])))
        yield pd.DataFrame({slot: [key[0]] * len(rows), frame: rows[frame], "track": tracks})

    return obs.groupBy(slot).applyInPandasWithState(run, f"`{slot}` {types[slot]}, `{frame}` {types[frame]}, track long", "id long, age long, fresh long, last long", "append", "NoTimeout")


def stream_sequences(obs: DataFrame, seq: str, frame: str, slot: str, score: str, at: str, active: float = ACTIVE, tolerance: int = TOLERANCE) -> DataFrame:
    """``track_sequences`` over a stream: ``seq, frame, slot, track``, with one id counter for all slots of a sequence.

    Ids are given in order of frame, then slot, across slots, so a frame may be taken only
    once no row of it can still come. Rows wait in state, with an event-time timer at the
    earliest ``at`` of them, the frame's time (which may not fall as ``frame`` rises within
    a sequence); when the watermark has passed it, all that it has passed are taken in order,
    and the timer moves on. So the result doesn't depend on how the stream is cut; rows later
    than the watermark are left out by Spark, rows that it hasn't passed yet stay waiting.
    Repeats of a frame and slot that wait together count once, the last one. ``obs`` needs a
    watermark on ``at``, the session the RocksDB state store, frames are numbers. A sequence's
    state is a map of its slots and the rows waiting, in chunks by spans of ``SPAN`` frames;
    its rows meet in one task, as the shared counter asks, but only a span's rows, or
    ``ROWS_KEPT`` rows that come in, are in memory at once.
    """
    types = dict(obs.dtypes)

    class Sequence(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.slots = handle.getMapState("slots", f"slot {types[slot]}", "id long, age long")
            self.fresh = handle.getValueState("fresh", "n long")
            self.spans = handle.getMapState("spans", "span long", "chunks long, earliest long")
            self.waiting = handle.getMapState("waiting", "span long, chunk long", f"at array<long>, frame array<{types[frame]}>, slot array<{types[slot]}>, score array<double>")

        def keep(self, parts: list[pd.DataFrame]) -> None:
            """Rows into the chunks of their spans; a span's next chunk each."""
            for span, own in pd.concat(parts).groupby("span"):
                low = int(own["millis"].min())
                chunks, earliest = tuple(self.spans.getValue((int(span),))) if self.spans.containsKey((int(span),)) else (0, low)
                self.waiting.updateValue((int(span), chunks), tuple(own[c].tolist() for c in ("millis", "frame", "slot", "score")))
                self.spans.updateValue((int(span),), (chunks + 1, min(earliest, low)))

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            parts, n, low = [], 0, None
            for part in rows:
                if not len(part):
                    continue
                parts.append(part)
                n += len(part)
                low = int(part["millis"].min()) if low is None else min(low, int(part["millis"].min()))
                if n >= ROWS_KEPT:
                    self.keep(parts)
                    parts, n = [], 0
            if parts:
                self.keep(parts)
            if low is not None:
                self.handle.registerTimer(low)
            yield pd.DataFrame([], columns=["seq", "frame", "slot", "track"], dtype=object)

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            bound = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
            spans = sorted((span[0], held[0]) for span, held in self.spans.iterator() if held[1] <= bound)
            if not spans:  # an earlier timer of this batch may have taken all
                return
            life = {}
            fresh = self.fresh.get()[0] if self.fresh.exists() else 0
            for span, chunks in spans:  # one span's rows at a time, in order of frame
                due, later = {}, []
                for k in range(chunks):
                    for t, f, s, value in zip(*self.waiting.getValue((span, k)), strict=True):
                        if t <= bound:
                            due[f, s] = value
                        else:
                            later.append((t, f, s, value))
                    self.waiting.removeKey((span, k))
                if later:
                    low = min(row[0] for row in later)
                    self.waiting.updateValue((span, 0), tuple(map(list, zip(*later, strict=True))))
                    self.spans.updateValue((span,), (1, low))
                    self.handle.registerTimer(low)
                else:
                    self.spans.removeKey((span,))
                out = []
                for f, s in sorted(due):
                    if s not in life:
                        life[s] = tuple(self.slots.getValue((s,))) if self.slots.containsKey((s,)) else (UNBORN, 0)
                    ident, age, fresh = advance((*life[s], fresh), due[f, s], active, tolerance)
                    life[s] = (ident, age)
                    out.append((key[0], f, s, ident))
                yield pd.DataFrame(out, columns=["seq", "frame", "slot", "track"], dtype=object)
            for s, state in life.items():
                self.slots.updateValue((s,), state)
            self.fresh.update((fresh,))

        def close(self) -> None:
            pass

    given = obs.select(F.col(seq).alias("seq"), F.col(frame).alias("frame"), F.col(slot).alias("slot"), F.col(score).cast("double").alias("score"), F.col(at).alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("millis"), F.floor(F.col(frame) / SPAN).cast("long").alias("span"))
    made = given.groupBy("seq").transformWithStateInPandas(Sequence(), f"seq {types[seq]}, frame {types[frame]}, slot {types[slot]}, track long", "Append", "EventTime")
    return made.select(F.col("seq").alias(seq), F.col("frame").alias(frame), F.col("slot").alias(slot), "track")


def accuracy(matches: DataFrame, seq: str, frame: str, truth: str, track: str) -> DataFrame:
    """Misses, false tracks, switches and MOTA by sequence, from rows of truth and track (either null)."""
    w = Window.partitionBy(seq, truth).orderBy(frame)
    seen = matches.withColumn("__was", F.last(F.when(F.col(track).isNotNull(), F.col(track)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    switch = F.col(truth).isNotNull() & F.col(track).isNotNull() & (F.col("__was") != F.col(track))
    out = seen.groupBy(seq).agg(
        F.sum((F.col(truth).isNotNull() & F.col(track).isNull()).cast("long")).alias("misses"),
        F.sum((F.col(truth).isNull() & F.col(track).isNotNull()).cast("long")).alias("false_tracks"),
        F.sum(F.coalesce(switch, F.lit(False)).cast("long")).alias("switches"),
        F.count(truth).alias("truths"),
    )
    return out.withColumn("mota", 1 - F.try_divide(F.col("misses") + F.col("false_tracks") + F.col("switches"), F.col("truths")))
