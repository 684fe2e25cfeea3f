"""Volunteers' reliability from votes: consistency, weighted votes, confusion matrices."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def consistency(votes: DataFrame) -> DataFrame:
    """``item, user, label, w, score`` of every vote (``item, user, label, w``).

    With f the weighted share of a label among the item's votes and k its labels, a vote for c scores
    (f(c) + sum of 1 - f over the other labels) / k.
    """
    sums = votes.groupBy("item", "label").agg(F.sum("w").alias("s"))
    totals = sums.groupBy("item").agg(F.sum("s").alias("all"), F.count(F.lit(1)).alias("k")).where(F.col("all") > 0)
    share = sums.join(totals, "item").select("item", "label", "k", (F.col("s") / F.col("all")).alias("f"))
    # the shares of all labels add up to one, so the others' part is (k - 1) - (1 - f)
    return votes.join(share, ["item", "label"]).select(
        "item", "user", "label", "w", ((F.col("f") + (F.col("k") - 1) - (1 - F.col("f"))) / F.col("k")).alias("score")
    )


def consistency_weights(votes: DataFrame, rounds: int = 2, at: float = 0.6, power: float = 2.0) -> DataFrame:
    """``user, weight`` after ``rounds`` of weight = min(1, (mean score / at) ** power), starting from equal weights."""
    current = votes.select("item", "user", "label").withColumn("w", F.lit(1.0))
    weights = None
    for n in range(rounds):
        mean = consistency(current).groupBy("user").agg(F.avg("score").alias("m"))
        weights = mean.select("user", F.least(F.lit(1.0), F.pow(F.col("m") / at, F.lit(power))).alias("weight"))
        if n + 1 < rounds:
            weights = durable(weights)
            current = votes.select("item", "user", "label").join(weights, "user").withColumnRenamed("weight", "w")
    return weights


def weighted_labels(votes: DataFrame) -> DataFrame:
    """``item, label``: the label with the largest summed ``w``; ties: the lowest label."""
    sums = votes.groupBy("item", "label").agg(F.sum("w").alias("s"))
    top = sums.groupBy("item").agg(F.max("s").alias("s"))
    return sums.join(top, ["item", "s"]).groupBy("item").agg(F.min("label").alias("label"))


def accuracy_against(votes: DataFrame, truth: DataFrame, least: int = 1) -> DataFrame:
    """``user, n, accuracy``: share of a volunteer's votes equal to ``truth`` (``item, label``), from ``least`` votes on."""
    both = votes.join(truth.withColumnRenamed("label", "true_label"), "item")
    return both.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("true_label")).cast("double")).alias("accuracy")).where(F.col("n") >= least)


def confusion_counts(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """``user, true_label, label, n``."""
    return votes.join(truth.withColumnRenamed("label", "true_label"), "item").groupBy("user", "true_label", "label").agg(F.count(F.lit(1)).alias("n"))


def plurality(votes: DataFrame) -> DataFrame:
    """``item, label``: the most voted label, ties the lowest."""
    return weighted_labels(votes.select("item", "label", F.lit(1.0).alias("w")))


def prior_counts(votes: DataFrame, labels: int, scale: float = 100.0) -> DataFrame:
    """``label, prior``: how many items have each plurality label, scaled to about ``scale``, at least 1."""
    counts = plurality(votes).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    every = votes.sparkSession.range(labels).select(F.col("id").cast("int").alias("label"))
    return every.join(counts, "label", "left").crossJoin(F.broadcast(total)).select(  # one row, and one for each label
        "label", F.greatest(F.lit(1), F.floor(F.coalesce("n", F.lit(0)) * scale / F.col("all")).cast("int")).alias("prior")
    )


def prior_confusion(votes: DataFrame, labels: int) -> DataFrame:
    """``true_label, label, count``: vote shares by plurality label, rows scaled to 10 for each label, at least 1."""
    share = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = votes.groupBy("item").agg(F.count(F.lit(1)).alias("all"))
    summed = (
        share.join(totals, "item").join(plurality(votes).withColumnRenamed("label", "true_label"), "item")
        .groupBy("true_label", "label").agg(F.sum(F.col("n") / F.col("all")).alias("s"))
    )
    rows = summed.groupBy("true_label").agg(F.sum("s").alias("row"))
    every = votes.sparkSession.range(labels * labels).select((F.col("id") / labels).cast("int").alias("true_label"), (F.col("id") % labels).cast("int").alias("label"))
    return every.join(summed, ["true_label", "label"], "left").join(rows, "true_label", "left").select(
        "true_label", "label",
        F.greatest(F.lit(1), F.floor(F.coalesce(F.col("s") * labels * 10 / F.col("row"), F.lit(0.0)) + 1e-9).cast("int")).alias("count"),
    )


def hard_em(votes: DataFrame, labels: int, gold: DataFrame | None = None, rounds: int = 50, correct: float = 0.8) -> DataFrame:
    """``item, label`` by alternating labels and one confusion matrix for each volunteer.

    An item gets the label with the largest product of chances (each at least 0.001; ties: the lowest), then every
    volunteer's matrix is counted again and its rows made to add up to 1. Items of ``gold`` keep their label. Ends
    when no label changes, or with a warning after ``rounds``. Matrices begin with ``correct`` on the diagonal.
    """
    votes = durable(votes.select("item", "user", "label"))
    off = (1 - correct) / max(labels - 1, 1)
    chance, last = None, None
    for _ in range(rounds):
        if chance is None:
            each = [F.when(F.col("label") == c, correct).otherwise(off) for c in range(labels)]
            rows = votes
        else:
            each = [F.greatest(F.coalesce(F.get("p", F.lit(c)), F.lit(0.0)), F.lit(0.001)) for c in range(labels)]
            rows = votes.join(chance, ["user", "label"], "left")
        score = rows.groupBy("item").agg(*(F.sum(F.ln(e)).alias(f"s{c}") for c, e in enumerate(each)))
        sums = F.transform(F.array(*(F.col(f"s{c}") for c in range(labels))), lambda x: F.round(x, 9))
        now = score.select("item", (F.array_position(sums, F.array_max(sums)) - 1).cast("int").alias("label"))
        if gold is not None:
            now = now.join(gold.withColumnRenamed("label", "g"), "item", "left").select("item", F.coalesce("g", "label").alias("label"))
        now = durable(now)
        if last is not None and now.exceptAll(last).isEmpty():
            return now
        last = now
        cells = confusion_counts(votes, now)
        given = cells.groupBy("user", "true_label").agg(F.sum("n").alias("all"))
        shares = cells.join(given, ["user", "true_label"]).select("user", "label", "true_label", (F.col("n") / F.col("all")).alias("p"))
        chance = shares.groupBy("user", "label").agg(F.array(*(F.max(F.when(F.col("true_label") == c, F.col("p"))) for c in range(labels))).alias("p"))
    warnings.warn(f"hard_em: labels may still change after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return last


def sweep_thresholds(scores: DataFrame, steps: int = 20) -> DataFrame:
    """``threshold, true_positives, false_positives`` at ``steps`` + 1 even thresholds over ``score, truth`` (0 or 1)."""
    grid = scores.sparkSession.createDataFrame([(float(t),) for t in np.linspace(0, 1, steps + 1)], "threshold double")
    binned = scores.select(F.floor(F.col("score") * steps + 1e-9).alias("b"), "truth").groupBy("b").agg(F.sum("truth").alias("t"), F.count(F.lit(1)).alias("n"))
    at = grid.join(F.broadcast(binned), F.col("b") >= F.col("threshold") * steps - 1e-6, "left")  # steps + 1 rows on either side
    return at.groupBy("threshold").agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("true_positives"), F.coalesce(F.sum(F.col("n") - F.col("t")), F.lit(0)).cast("long").alias("false_positives"))
