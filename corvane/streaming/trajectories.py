"""Whole trajectories compared: identity scores by one assignment a sequence, alignment scores over a sweep of thresholds.

Rows are ``pairs`` (a truth and a track of one frame and their ``similarity``, where it is
over 0), ``truths`` and ``tracks`` (who is present in each frame). What grows with frames is
counted by grouped sums; only a sequence's counts by identity, whose size is that of its
identities, and the pairs of one frame that contend with each other are assigned in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.operators.boxes import best_pairs

#: Similarity thresholds of the alignment scores.
ALPHAS = tuple(round(0.05 * k, 2) for k in range(1, 20))


def identity(pairs: DataFrame, truths: DataFrame, tracks: DataFrame, seq: str = "seq", truth: str = "truth", track: str = "track", similarity: str = "similarity", threshold: float = 0.5) -> DataFrame:
    """``idtp, idfn, idfp, idr, idp, idf1`` of each sequence, under the one-to-one assignment of whole trajectories that matches most frames."""
    shared = pairs.where(F.col(similarity) >= threshold).groupBy(seq, truth, track).agg(F.count("*").cast("double").alias("frames"))
    found = best_pairs(shared, [seq], truth, track, "frames").groupBy(seq).agg(F.sum("frames").cast("long").alias("idtp"))
    n = truths.groupBy(seq).agg(F.count("*").alias("__truths")).join(tracks.groupBy(seq).agg(F.count("*").alias("__tracks")), seq, "full_outer").join(found, seq, "left").na.fill(0, ["__truths", "__tracks", "idtp"])
    share = lambda whole: F.coalesce(F.try_divide(F.col("idtp").cast("double"), whole), F.lit(0.0))
    return n.select(
        seq, "idtp", (F.col("__truths") - F.col("idtp")).alias("idfn"), (F.col("__tracks") - F.col("idtp")).alias("idfp"),
        share(F.col("__truths")).alias("idr"), share(F.col("__tracks")).alias("idp"), share((F.col("__truths") + F.col("__tracks")) / 2).alias("idf1"),
    )


def aligned(pairs: DataFrame, truths: DataFrame, tracks: DataFrame, seq: str = "seq", frame: str = "frame", truth: str = "truth", track: str = "track", similarity: str = "similarity") -> DataFrame:
    """The pairs of each frame that are matched: those of the largest sum of similarity times how well the two trajectories align as a whole."""
    of = lambda who: F.sum(similarity).over(Window.partitionBy(seq, frame, who))
    one = pairs.withColumn("__one", F.col(similarity) / (of(truth) + of(track) - F.col(similarity)))
    sizes = lambda df, who, name: df.groupBy(seq, who).agg(F.count("*").alias(name))
    whole = one.groupBy(seq, truth, track).agg(F.sum("__one").alias("__both")).join(sizes(truths, truth, "__a"), [seq, truth]).join(sizes(tracks, track, "__b"), [seq, track])
    score = whole.select(seq, truth, track, (F.col("__both") / (F.col("__a") + F.col("__b") - F.col("__both"))).alias("__whole"))
    scored = pairs.join(score, [seq, truth, track]).select(seq, frame, truth, track, similarity, (F.col("__whole") * F.col(similarity)).alias("score"))
    return scored.join(best_pairs(scored, [seq, frame], truth, track, "score").select(seq, frame, truth, track), [seq, frame, truth, track])


def alignment(pairs: DataFrame, truths: DataFrame, tracks: DataFrame, seq: str = "seq", frame: str = "frame", truth: str = "truth", track: str = "track", similarity: str = "similarity", alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """``hota, deta, assa, detre, detpr, assre, asspr, loca`` of each sequence, means over the thresholds ``alphas``."""
    level = F.size(F.filter(F.array(*map(F.lit, alphas)), lambda a: F.col(similarity) >= a - 1e-15))
    held = aligned(pairs, truths, tracks, seq, frame, truth, track, similarity).withColumn("__level", level).where("__level > 0")
    counts = held.groupBy(seq, truth, track, "__level").agg(F.count("*").alias("n"), F.sum(similarity).alias("sim"))
    each = counts.withColumn("k", F.explode(F.sequence(F.lit(1), "__level"))).groupBy(seq, truth, track, "k").agg(F.sum("n").alias("n"), F.sum("sim").alias("sim"))
    sizes = lambda df, who, name: df.groupBy(seq, who).agg(F.count("*").alias(name))
    each = each.join(sizes(truths, truth, "a"), [seq, truth]).join(sizes(tracks, track, "b"), [seq, track])
    part = lambda whole: F.sum(F.col("n") * F.col("n") / whole)
    by_alpha = each.groupBy(seq, "k").agg(F.sum("n").alias("tp"), F.sum("sim").alias("sim"), part(F.col("a") + F.col("b") - F.col("n")).alias("ass"), part(F.col("a")).alias("re"), part(F.col("b")).alias("pr"))
    total = truths.groupBy(seq).agg(F.count("*").alias("truths")).join(tracks.groupBy(seq).agg(F.count("*").alias("tracks")), seq, "full_outer").na.fill(0, ["truths", "tracks"])
    grid = total.withColumn("k", F.explode(F.array(*(F.lit(k + 1) for k in range(len(alphas)))))).join(by_alpha, [seq, "k"], "left").na.fill(0, ["tp"]).na.fill(0.0, ["sim", "ass", "re", "pr"])
    tp, one = F.col("tp"), F.lit(1)
    rates = {
        "deta": tp / F.greatest(F.col("truths") + F.col("tracks") - tp, one), "assa": F.col("ass") / F.greatest(tp, one),
        "detre": tp / F.greatest(F.col("truths"), one), "detpr": tp / F.greatest(F.col("tracks"), one),
        "assre": F.col("re") / F.greatest(tp, one), "asspr": F.col("pr") / F.greatest(tp, one),
        "loca": F.greatest(F.col("sim"), F.lit(1e-10)) / F.greatest(tp.cast("double"), F.lit(1e-10)),
    }
    rated = grid.select(seq, *(c.alias(n) for n, c in rates.items())).withColumn("hota", F.sqrt(F.col("deta") * F.col("assa")))
    return rated.groupBy(seq).agg(*(F.avg(n).alias(n) for n in ("hota", *rates)))
