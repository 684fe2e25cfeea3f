"""Score accumulation from ordered yes/no tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = (-1, 1, 3)


def score_bin(answers: Column, yes: int = 1) -> Column:
    """Bin of four ordered answers: 0 if the first three are all yes, else 2 if the last is, else 1; null if there are fewer."""
    first = (F.get(answers, F.lit(0)) == yes) & (F.get(answers, F.lit(1)) == yes) & (F.get(answers, F.lit(2)) == yes)
    return F.when(F.size(answers) >= 4, F.when(first, 0).when(F.get(answers, F.lit(3)) == yes, 2).otherwise(1))


def accumulate(bins: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n0, n1, n2, n, mean, std``: counts of each bin and the weighted mean and population deviation."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.col("bin") + 1)
    return bins.where("bin IS NOT NULL").groupBy(*keys).agg(
        *(F.count_if(F.col("bin") == b).alias(f"n{b}") for b in range(3)), F.count(F.lit(1)).alias("n"),
        F.avg(weight).alias("mean"), F.stddev_pop(weight).alias("std"),
    )


def merge_counts(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and new counts of bins added up, with mean and deviation from the sums."""
    both = stored.select(*keys, "n0", "n1", "n2").unionByName(new.select(*keys, "n0", "n1", "n2"))
    sums = both.groupBy(*keys).agg(*(F.sum(f"n{b}").alias(f"n{b}") for b in range(3)))
    n = F.col("n0") + F.col("n1") + F.col("n2")
    mean = sum(F.col(f"n{b}") * float(w) for b, w in enumerate(WEIGHTS)) / n
    square = sum(F.col(f"n{b}") * float(w * w) for b, w in enumerate(WEIGHTS)) / n
    return sums.select("*", n.alias("n"), mean.alias("mean"), F.sqrt(square - mean * mean).alias("std"))


def volunteers(rows: DataFrame) -> DataFrame:
    """``volunteers, classifications``: distinct users plus distinct addresses of those without a user."""
    return rows.agg(
        (F.count_distinct("user_id") + F.count_distinct(F.when(F.col("user_id").isNull(), F.col("user_ip")))).alias("volunteers"),
        F.count(F.lit(1)).alias("classifications"),
    )
