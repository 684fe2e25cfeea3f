"""Session defaults, durable cuts of lineage, and checks of size before a broadcast."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", app: str = "tallyfield", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfield-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once for each row.

    Filters and later projections aren't pushed through the generator, so a costly expression isn't repeated in them.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of stages whose results have been written (it waits for its driver's garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` stay within ``limit``; else leave the choice to Spark."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, *keys: str):
    """``df`` grouped by ``keys`` for a Python kernel, over as many tasks as there are.

    Left to itself the adaptive plan would put small rows into few tasks, however much work a group is.
    """
    return df.repartition(parallelism(df.sparkSession), *keys).groupBy(*keys)


def parallelism(spark: SparkSession) -> int:
    """Tasks that one balanced stage should have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
