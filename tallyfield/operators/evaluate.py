"""Comparing results with gold labels, with each other, and over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .pointers import components


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of coordinates."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], within: float, same: bool = False) -> DataFrame:
    """Pairs of points of one key at most ``within`` apart: ``keys, left_id, right_id, d`` from ``keys, pid, x, y``.

    A range join: points fall into square cells as wide as the distance, and a point meets only those of its own
    and the eight neighbouring cells. With ``same``, each pair of one table once (``left_id < right_id``).
    """
    cell = lambda c: F.floor(F.col(c) / within).cast("long")
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    a = left.select(*keys, F.col("pid").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = right.select(*keys, F.col("pid").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("ux"), cell("y").alias("uy"))
    b = b.withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around)).select("*", (F.col("ux") + F.col("ox")).alias("cx"), (F.col("uy") + F.col("oy")).alias("cy"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    pairs = a.join(b.drop("ox", "oy", "ux", "uy"), [*keys, "cx", "cy"]).select(*keys, "left_id", "right_id", d.alias("d")).where(F.col("d") <= within)
    return pairs.where("left_id < right_id") if same else pairs


def mutual_nearest(left: DataFrame, right: DataFrame, keys: list[str], within: float) -> DataFrame:
    """Pairs that are each other's nearest at most ``within`` apart; ties by the lower id."""
    pairs = near_pairs(left, right, keys, within)
    to_right = pairs.groupBy(*keys, "left_id").agg(F.min(F.struct("d", "right_id")).alias("n")).select(*keys, "left_id", F.col("n.right_id").alias("right_id"), F.col("n.d").alias("d"))
    to_left = pairs.groupBy(*keys, "right_id").agg(F.min(F.struct("d", "left_id")).alias("n")).select(*keys, "right_id", F.col("n.left_id").alias("left_id"))
    return to_right.join(to_left, [*keys, "left_id", "right_id"])


def overlapping_rectangles(rects: DataFrame, keys: list[str], cell: float = 256.0) -> DataFrame:
    """Pairs of rectangles of one key that overlap: ``keys, left_id, right_id``, from ``keys, pid, x1, y1, x2, y2``.

    Rectangles meet in the cells they cover; a pair is kept in the one cell that holds the corner of its overlap.
    """
    covered = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    placed = rects.select("*", covered("x1", "x2").alias("cx")).select("*", covered("y1", "y2").alias("cy"))
    a = placed.select(*keys, "cx", "cy", *(F.col(c).alias(f"a_{c}") for c in ("pid", "x1", "y1", "x2", "y2")))
    b = placed.select(*keys, "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in ("pid", "x1", "y1", "x2", "y2")))
    x, y = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    meets = (x <= F.least("a_x2", "b_x2")) & (y <= F.least("a_y2", "b_y2")) & (F.col("a_pid") < F.col("b_pid"))
    own = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    return a.join(b, [*keys, "cx", "cy"]).where(meets & own).select(*keys, F.col("a_pid").alias("left_id"), F.col("b_pid").alias("right_id"))


def overlap_groups(rects: DataFrame, keys: list[str], cell: float = 256.0) -> DataFrame:
    """``keys, pid, group, group_size, links`` of every rectangle: its group of chained overlaps, and how many it overlaps itself.

    Equal rectangles are one for the search. A rectangle that overlaps none is a group of one.
    """
    box = ["x1", "y1", "x2", "y2"]
    named = rects.withColumn("rep", F.xxhash64(*keys, *box))
    distinct = durable(named.groupBy(*keys, *box, "rep").agg(F.count(F.lit(1)).alias("n")))
    pairs = durable(overlapping_rectangles(distinct.withColumnRenamed("rep", "pid"), keys, cell).select("left_id", "right_id"))
    size = distinct.select(F.col("rep").alias("right_id"), "n")
    both = pairs.unionByName(pairs.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    links = both.join(size, "right_id").groupBy(F.col("left_id").alias("rep")).agg(F.sum("n").alias("others"))
    label = components(pairs.select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))).withColumnRenamed("node", "rep")
    grouped = distinct.join(label, "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("group"))
    sizes = grouped.groupBy("group").agg(F.sum("n").alias("group_size"))
    each = grouped.join(links, "rep", "left").join(sizes, "group").select("rep", "group", "group_size", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
    return named.join(each, "rep").select(*keys, "pid", "group", "group_size", "links")


def running_totals(counts: DataFrame, order: Column, *values: str) -> DataFrame:
    """``counts`` (one row for each distinct value of ``order``) with sums over all rows up to each in that order.

    Rows are cut into ranges; each sums its own, on top of the totals of the ranges before it. Only those totals, a
    row for each range, meet in one task.
    """
    placed = durable(counts.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(*(F.sum(v).alias(f"all_{v}") for v in values))
    ranges = ranges.select("range", *(F.coalesce(F.sum(f"all_{v}").over(before), F.lit(0)).alias(f"before_{v}") for v in values))
    upto = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(F.broadcast(ranges), "range")  # a row for each range
    return run.select(*counts.columns, *((F.sum(v).over(upto) + F.col(f"before_{v}")).cast("long").alias(f"cum_{v}") for v in values))


def roc(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """``score, cum_t, cum_f``: true and false positives at every distinct score, highest first; with ``digits`` at every rounded one."""
    score = F.col("score") if digits is None else F.round("score", digits)
    counts = scores.groupBy(score.alias("score")).agg(F.sum("truth").cast("long").alias("t"), F.count_if(F.col("truth") == 0).alias("f"))
    return running_totals(counts, F.desc("score"), "t", "f").select("score", "cum_t", "cum_f")


def ks_distance(samples: DataFrame, digits: int = 12) -> DataFrame:
    """``ks``: largest difference of the distribution functions of ``value`` for ``side`` 0 and 1, in [0, 1].

    Values count as equal at ``digits``, so that means summed in another order are.
    """
    counts = samples.groupBy(F.round("value", digits).alias("value")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = running_totals(counts, F.asc("value"), "a", "b").crossJoin(F.broadcast(totals))  # one row
    return run.agg(F.max(F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))).alias("ks"))


def log_loss(scores: DataFrame, keys: list[str], least: float = 1e-15) -> DataFrame:
    """``keys, log_loss``: mean of -ln of the chance given to the truth, clipped."""
    p = F.least(F.greatest("score", F.lit(least)), F.lit(1 - least))
    return scores.groupBy(*keys).agg(F.avg(F.when(F.col("truth") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))).alias("log_loss"))


def outcome_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, tp, tn, fp, fn`` of ``predicted`` and ``truth`` (0 or 1)."""
    n = lambda p, t: F.count_if((F.col("predicted") == p) & (F.col("truth") == t))
    return pairs.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(1, 0).alias("fp"), n(0, 1).alias("fn"))


def others_mean(votes: DataFrame, item: str, user: str, value: str) -> DataFrame:
    """``item, user, own, others``: a volunteer's mean and that of everybody else on the item; null if there is nobody."""
    mine = votes.groupBy(item, user).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    everybody = mine.groupBy(item).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = F.col("all_n") - F.col("n")
    return mine.join(everybody, item).select(item, user, (F.col("s") / F.col("n")).alias("own"), F.when(rest > 0, (F.col("all_s") - F.col("s")) / rest).alias("others"))


def kernel_mean(points: DataFrame, keys: list[str], within: float, scale: float) -> DataFrame:
    """``keys, pid, smooth``: Gaussian-weighted mean distance of a point's neighbours within a radius."""
    pairs = near_pairs(points, points, keys, within).where("left_id <> right_id")
    w = F.exp(-F.col("d") * F.col("d") / (scale * scale))
    return pairs.groupBy(*keys, F.col("left_id").alias("pid")).agg((F.sum(w * F.col("d")) / F.sum(w)).alias("smooth"))


def first_n(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Each input partition first drops what it can't contribute (Spark's limit within window groups), so a hot group
    is cut down before it is shuffled to one task.
    """
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)


def shared_items(votes: DataFrame, item: str, user: str, least: int = 2) -> DataFrame:
    """``item, users``: items that at least ``least`` volunteers saw."""
    return votes.groupBy(item).agg(F.count_distinct(user).alias("users")).where(F.col("users") >= least)


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that ``before`` doesn't have, repeated rows counted."""
    return durable(after).exceptAll(before)
