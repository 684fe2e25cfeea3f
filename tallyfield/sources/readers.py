"""Reading classifications and companions from other formats into the tables' schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSIFICATIONS = (
    "id bigint, user_id bigint, user_name string, workflow_id int, workflow_version string, subject_id bigint, "
    "created_at timestamp, user_ip string, gold_standard boolean, annotations string, metadata string"
)


def csv_export(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export: the subject is the first key of ``subject_data``; rows are numbered where ``id`` is missing."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.monotonically_increasing_id())
    first = F.get(F.json_object_keys("subject_data"), F.lit(0)).try_cast("bigint")
    have = {f.split()[0]: f.split()[1] for f in CLASSIFICATIONS.split(", ")}
    rows = rows.withColumn("subject_id", first)
    return rows.select(*(F.col(c).try_cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Classification documents, one JSON object a line; nested annotations and metadata become JSON text."""
    return spark.read.schema(CLASSIFICATIONS).json(path)


def legacy(spark: SparkSession, path: str, subject: str = "subject") -> DataFrame:
    """Documents that name a subject in the field ``subject``: ``subject, user_key, annotations``, the first row of each pair.

    The user is the name, else the address; documents whose second annotation says they were finished are left out.
    """
    schema = f"`{subject}` string, user_name string, user_ip string, id bigint, annotations string"
    rows = spark.read.schema(schema).json(path)
    rows = rows.where(F.get_json_object("annotations", "$[1].finished_at").isNull())
    key = F.coalesce("user_name", "user_ip")
    return rows.groupBy(F.col(subject).alias("subject"), key.alias("user_key")).agg(F.min_by("annotations", "id").alias("annotations"))


def species_votes(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file ``subject, user, species``: no header, quotes, tutorials or malformed species; blank is none."""
    rows = spark.read.option("sep", "\t").schema("subject string, user string, species string, event string").csv(path)
    bare = lambda c: F.btrim(c, F.lit('" '))
    rows = rows.select(bare("subject").alias("subject"), bare("user").alias("user"), bare("species").alias("species"), bare("event").alias("event"))
    rows = rows.where("subject <> 'subject' AND coalesce(event, '') <> 'tutorial' AND coalesce(species, '') NOT LIKE '%:%'")
    return rows.select("subject", "user", F.when(F.length("species") > 0, F.col("species")).alias("species"))


def regions_of_interest(spark: SparkSession, path: str, scale: float = 1 / 1.92) -> DataFrame:
    """A tab-separated file of a path and ``x,y`` vertices: ``path, points``, scaled."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") > 1)
    point = lambda p: F.struct((F.split(p, ",")[0].try_cast("double") * scale).alias("x"), (F.split(p, ",")[1].try_cast("double") * scale).alias("y"))
    return rows.select(F.col("f")[0].alias("path"), F.transform(F.slice("f", F.lit(2), F.size("f")), point).alias("points"))


def jdbc(spark: SparkSession, url: str, query: str, low: int, high: int, parts: int, column: str = "id", **options: str) -> DataFrame:
    """A relational source read in ranges of a numeric key, one range for each task."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    return reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def after(rows: DataFrame, last_id: int | None) -> DataFrame:
    """Rows that arrived after the last id taken in; all of them where none was."""
    return rows if last_id is None else rows.where(F.col("id") > last_id)


def inside_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``points`` (``path, x, y``) with ``inside``: on or below the polyline of their path; true where it has none.

    A point left or right of the whole line is outside.
    """
    on = points.join(regions, "path", "left")
    segments = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))

    def below(s):
        a, b = s["a"], s["b"]
        t = F.when(b["x"] != a["x"], (F.col("x") - a["x"]) / (b["x"] - a["x"])).otherwise(0.0)
        return (F.col("x") >= F.least(a["x"], b["x"])) & (F.col("x") <= F.greatest(a["x"], b["x"])) & (F.col("y") >= a["y"] + t * (b["y"] - a["y"]))

    inside = F.when(F.col("points").isNull(), True).when(F.size("points") < 2, False).otherwise(F.exists(segments, below))
    return on.select(*points.columns, inside.alias("inside"))
