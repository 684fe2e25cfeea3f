"""Votes on questions: counts, shares, agreement, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUESTION = ["workflow_id", "subject_id", "task"]


def vote_count(ballots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, answer, votes, p, num_users`` from ``keys, choices``.

    Every element of ``choices`` is a vote, ``p`` its share of all votes, ``num_users`` the number of ballots with
    null and empty ones included. Questions without any vote give no row.
    """
    keys = keys or QUESTION
    said = ballots.select(*keys, F.posexplode_outer("choices").alias("at", "answer"))
    per = said.groupBy(*keys, "answer").agg(F.count("answer").alias("votes"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("first"))
    whole = Window.partitionBy(*keys)  # a row for each answer of a question
    out = per.select("*", F.sum("votes").over(whole).alias("all"), F.sum("first").over(whole).alias("num_users"))
    return out.where("answer IS NOT NULL").select(*keys, "answer", "votes", (F.col("votes") / F.col("all")).alias("p"), "num_users")


def entropy(p: Column) -> Column:
    """Shannon entropy in nats of shares in a group."""
    return -F.sum(p * F.ln(p))


def summary(counted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The likeliest answer of each question (ties: the lowest), its share, entropy, mean and median share."""
    keys = keys or QUESTION
    return counted.groupBy(*keys).agg(
        F.max_by("answer", F.struct("p", -F.col("answer"))).alias("most_likely"), F.max("p").alias("p_most_likely"),
        entropy(F.col("p")).alias("shannon_entropy"), F.avg("p").alias("mean_agreement"), F.median("p").alias("median_agreement"),
        F.max("num_users").alias("num_users"),
    )


def detail(counted: DataFrame, answers: list[int], keys: list[str] | None = None) -> DataFrame:
    """One row for each question with a column ``p_<answer>`` for each answer (0 where nobody gave it)."""
    keys = keys or QUESTION
    out = counted.groupBy(*keys).agg(
        *(F.coalesce(F.max(F.when(F.col("answer") == a, F.col("p"))), F.lit(0.0)).alias(f"p_{a}") for a in answers),
        F.max("num_users").alias("num_users"),
    )
    return out


def thresholded(counted: DataFrame, answer: int, least: float, keys: list[str] | None = None) -> DataFrame:
    """``keys, label``: whether ``answer`` has at least the share ``least``."""
    keys = keys or QUESTION
    share = F.coalesce(F.max(F.when(F.col("answer") == answer, F.col("p"))), F.lit(0.0))
    return counted.groupBy(*keys).agg((share >= least).cast("int").alias("label"))


def majority_labels(votes: DataFrame, item: str, label: str, least_votes: int = 10) -> DataFrame:
    """``item, labels``: sorted labels with at least half as many votes as the item has votes, if it has enough."""
    counts = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(item).agg(F.sum("n").alias("all"))
    kept = counts.join(totals, item).where((F.col("all") >= least_votes) & (F.col("n") * 2 >= F.col("all")))
    return kept.groupBy(item).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


def label_sets(votes: DataFrame, item: str, user: str, label: str) -> DataFrame:
    """``item, user, labels``: the distinct labels a volunteer gave to an item, sorted and joined."""
    return votes.groupBy(item, user).agg(F.array_join(F.array_sort(F.collect_set(label)), "_").alias("labels"))


def vote_distribution(votes: DataFrame, item: str, label: str, weight: Column | None = None) -> DataFrame:
    """``item, label, share``: each label's part of the summed weights."""
    w = weight if weight is not None else F.lit(1.0)
    sums = votes.groupBy(item, label).agg(F.sum(w).alias("s"))
    totals = sums.groupBy(item).agg(F.sum("s").alias("all"))
    return sums.join(totals, item).where(F.col("all") > 0).select(item, label, (F.col("s") / F.col("all")).alias("share"))


def most_likely_tool(members: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, tool, p``: the tool most members used (ties: the highest), and its share."""
    counts = members.groupBy(*keys, "tool").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", "tool")).alias("top"), F.sum("n").alias("all")).select(
        *keys, F.col("top.tool").alias("tool"), (F.col("top.n") / F.col("all")).alias("p_tool")
    )


def existence(members: DataFrame, viewers: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """``keys, cluster, p_true_positive, num_viewers``: share of those who saw the subject that are in the cluster."""
    seen = viewers.groupBy(*keys).agg(F.count_distinct("volunteer").alias("num_viewers"))
    inside = members.groupBy(*keys, cluster).agg(F.count_distinct("volunteer").alias("n"))
    return inside.join(seen, keys).select(*keys, cluster, (F.col("n") / F.col("num_viewers")).alias("p_true_positive"), "num_viewers")


def running_majority(votes: DataFrame, item: str, order: str, label: str, first: int) -> DataFrame:
    """Items whose first ``first`` votes all agree, with the label: ``item, label``."""
    nth = F.row_number().over(Window.partitionBy(item).orderBy(order))
    head = votes.withColumn("nth", nth).where(F.col("nth") <= first)
    return head.groupBy(item).agg(F.count_distinct(label).alias("k"), F.max("nth").alias("n"), F.min(label).alias("label")).where((F.col("k") == 1) & (F.col("n") == first)).select(item, "label")
