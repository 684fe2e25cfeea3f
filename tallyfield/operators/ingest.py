"""From classification rows to long tables: entries of tasks, workflow definitions, marks with their geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.annotations import entries, index_ballot, plain_json
from .dedup import last_write

#: What makes two deliveries the same classification; the one with the highest id counts.
IDENTITY = ["workflow_id", "subject_id", "workflow_version", "user_id", "user_ip"]


def major_version(version: Column) -> Column:
    """The part of a version before its first dot, as a number; null where it is none."""
    return F.split(version, r"\.")[0].try_cast("int")


def latest(classifications: DataFrame, major: dict[int, int] | None = None, at_least: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One row for each identity, with ``volunteer`` (the user's id, or a negative number of their own for nameless rows).

    ``major`` keeps the given major version of each workflow (with ``at_least``, that or a later one). With ``columns``
    only these come along with the identity and ``id``, so nothing else is read or shuffled.
    """
    rows = classifications if columns is None else classifications.select(*IDENTITY, "id", *columns)
    if "gold_standard" in rows.columns:
        rows = rows.withColumn("gold_standard", F.coalesce("gold_standard", F.lit(False)))
    if major is not None:
        wanted = F.create_map(*(F.lit(x) for pair in major.items() for x in pair))[F.col("workflow_id")]
        have = major_version(F.col("workflow_version"))
        rows = rows.where(have >= wanted if at_least else have == wanted)
    return last_write(rows, IDENTITY).withColumn("volunteer", F.coalesce("user_id", -F.col("id")))


def task_entries(rows: DataFrame) -> DataFrame:
    """A row for each entry of ``annotations``: the other columns, ``task`` and ``value`` (JSON text)."""
    kept = [c for c in rows.columns if c not in ("annotations", "metadata")]
    return rows.select(*kept, F.explode(entries(F.col("annotations"))).alias("e")).select(*kept, "e.task", "e.value")


def workflow_tasks(workflows: DataFrame) -> DataFrame:
    """``workflow_id, task, type, question, n_answers, n_tools`` of every task."""
    parsed = F.expr("try_variant_get(try_parse_json(tasks), '$', 'map<string, variant>')")
    return (
        workflows.select(F.col("id").alias("workflow_id"), F.explode(parsed).alias("task", "t"))
        .select(
            "workflow_id", "task", F.expr("try_variant_get(t, '$.type', 'string')").alias("type"),
            F.expr("coalesce(try_variant_get(t, '$.question', 'string'), try_variant_get(t, '$.instruction', 'string'))").alias("question"),
            F.expr("coalesce(size(try_variant_get(t, '$.answers', 'array<variant>')), 0)").alias("n_answers"),
            F.expr("coalesce(size(try_variant_get(t, '$.tools', 'array<variant>')), 0)").alias("n_tools"),
        )
    )


def answer_labels(workflows: DataFrame) -> DataFrame:
    """``workflow_id, task, answer, label``: labels of answers without apostrophes."""
    parsed = F.expr("try_variant_get(try_parse_json(tasks), '$', 'map<string, variant>')")
    tasks = workflows.select(F.col("id").alias("workflow_id"), F.explode(parsed).alias("task", "t"))
    return tasks.select("workflow_id", "task", F.posexplode(F.expr("try_variant_get(t, '$.answers', 'array<variant>')")).alias("answer", "a")).select(
        "workflow_id", "task", "answer", F.replace(F.expr("try_variant_get(a, '$.label', 'string')"), F.lit("'"), F.lit("")).alias("label")
    )


def tools(workflows: DataFrame) -> DataFrame:
    """``workflow_id, task, tool, shape, label, n_details`` of drawing tasks."""
    parsed = F.expr("try_variant_get(try_parse_json(tasks), '$', 'map<string, variant>')")
    tasks = workflows.select(F.col("id").alias("workflow_id"), F.explode(parsed).alias("task", "t"))
    return tasks.select("workflow_id", "task", F.posexplode(F.expr("try_variant_get(t, '$.tools', 'array<variant>')")).alias("tool", "a")).select(
        "workflow_id", "task", "tool", F.expr("try_variant_get(a, '$.type', 'string')").alias("shape"),
        F.expr("try_variant_get(a, '$.label', 'string')").alias("label"),
        F.expr("coalesce(size(try_variant_get(a, '$.details', 'array<variant>')), 0)").alias("n_details"),
    )


def choices(value: Column, n_answers: Column) -> Column:
    """Answers of a single or multiple ballot as indices; null for a null ballot, empty for anything unreadable."""
    many = F.filter(F.transform(F.from_json(value, "array<string>"), lambda v: index_ballot(v, n_answers)), lambda v: v.isNotNull())
    one = index_ballot(value, n_answers)
    none = F.array().cast("array<int>")
    return F.when(value.isNull(), F.lit(None)).when(F.ltrim(value).startswith("["), F.coalesce(many, none)).when(one.isNotNull(), F.array(one)).otherwise(none)


def dimensions(metadata: Column) -> Column:
    """struct(height, width) of the last entry of ``subject_dimensions`` that isn't null."""
    dims = F.from_json(F.get_json_object(plain_json(metadata), "$.subject_dimensions"), "array<struct<naturalHeight:double,naturalWidth:double>>")
    last = F.try_element_at(F.filter(dims, lambda d: d["naturalHeight"].isNotNull() & d["naturalWidth"].isNotNull()), F.lit(-1))
    return F.struct(last["naturalHeight"].alias("height"), last["naturalWidth"].alias("width"))


def subject_dimensions(rows: DataFrame) -> DataFrame:
    """``subject_id, height, width`` from the first classification of each subject."""
    first = rows.groupBy("subject_id").agg(F.min_by("metadata", "id").alias("metadata"))
    return first.select("subject_id", dimensions(F.col("metadata")).alias("d")).select("subject_id", "d.height", "d.width")


MARK = (
    "struct<tool:int,type:string,x:double,y:double,x1:double,y1:double,x2:double,y2:double,width:double,height:double,"
    "r:double,rx:double,ry:double,angle:double,points:array<struct<x:double,y:double>>,startPoint:struct<x:double,y:double>,"
    "endPoint:struct<x:double,y:double>,text:string,variants:array<string>>"
)
MAX_COORDINATE = 100_000.0


def marks(rows: DataFrame, tool_shapes: DataFrame) -> DataFrame:
    """``id, workflow_id, subject_id, volunteer, task, item, tool, shape, params, points, text, variants`` of every readable mark.

    A mark names its tool or its shape; its geometry must be complete (see ``shape_params``). Marks inside combos
    count with the inner task. Null entries, other values and marks of unknown tools are left out.
    """
    flat = task_entries(rows)
    inner = flat.where("value LIKE '[%' AND value LIKE '%\"task\"%'").select(
        *[c for c in flat.columns if c not in ("task", "value")],
        F.explode(F.from_json("value", "array<struct<task:string,value:string>>")).alias("e"),
    ).select("*", "e.task", "e.value").drop("e").where("task IS NOT NULL")
    both = flat.unionByName(inner).where("value LIKE '[%'")
    items = both.select("id", "workflow_id", "subject_id", "volunteer", "task", F.posexplode(F.from_json("value", "array<string>")).alias("item", "j"))
    parsed = items.where("j LIKE '{%'").select("*", F.from_json("j", MARK).alias("m")).drop("j")
    named = parsed.join(F.broadcast(tool_shapes.select("workflow_id", "task", F.col("tool").alias("t"), F.col("shape").alias("s"))),
                        ["workflow_id", "task"])  # a row for each tool of the project
    mine = F.when(F.col("m.tool").isNotNull(), F.col("m.tool") == F.col("t")).otherwise(F.col("m.type") == F.col("s"))
    known = named.where(mine).groupBy("id", "workflow_id", "subject_id", "volunteer", "task", "item").agg(F.min(F.struct("t", "s")).alias("k"), F.first("m").alias("m"))
    return known.select(
        "id", "workflow_id", "subject_id", "volunteer", "task", "item", F.col("k.t").alias("tool"), F.col("k.s").alias("shape"),
        shape_params(F.col("k.s"), F.col("m")).alias("params"), "m.points", "m.text", "m.variants",
    ).where("params IS NOT NULL")


def shape_params(shape: Column, m: Column) -> Column:
    """Parameters by shape, null where the geometry is incomplete, blank, not a number or negative beyond reason.

    point (x, y) within 0..100000; line (x1, y1, x2, y2) from left to right without negative coordinates; rectangle
    as two opposite corners with positive size; circle (x, y, r); ellipse (x, y, rx, ry, angle); polygon and bezier
    as the flat list of vertices; text (x1, x2, y1, y2) from left to right.
    """
    inside = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= MAX_COORDINATE)
    real = lambda c: c.isNotNull() & ~F.isnan(c)
    line = F.when(m["x1"] <= m["x2"], F.array(m["x1"], m["y1"], m["x2"], m["y2"])).otherwise(F.array(m["x2"], m["y2"], m["x1"], m["y1"]))
    s, e = m["startPoint"], m["endPoint"]
    text = F.when(s["x"] <= e["x"], F.array(s["x"], e["x"], s["y"], e["y"])).otherwise(F.array(e["x"], s["x"], e["y"], s["y"]))
    corners = F.flatten(F.transform(m["points"], lambda p: F.array(p["x"], p["y"])))
    all_real = F.forall(corners, lambda c: c.isNotNull())
    return (
        F.when((shape == "point") & inside(m["x"]) & inside(m["y"]), F.array(m["x"], m["y"]))
        .when((shape == "line") & inside(m["x1"]) & inside(m["y1"]) & inside(m["x2"]) & inside(m["y2"]), line)
        .when(
            shape.isin("rectangle", "image") & inside(m["x"]) & inside(m["y"]) & (m["width"] > 0) & (m["height"] > 0),
            F.array(m["x"], m["y"], m["x"] + m["width"], m["y"] + m["height"]),
        )
        .when((shape == "circle") & real(m["x"]) & real(m["y"]) & (m["r"] > 0), F.array(m["x"], m["y"], m["r"]))
        .when((shape == "ellipse") & real(m["x"]) & real(m["y"]) & real(m["rx"]) & real(m["ry"]) & real(m["angle"]), F.array(m["x"], m["y"], m["rx"], m["ry"], m["angle"]))
        .when((shape == "polygon") & (F.size(m["points"]) >= 3) & all_real, corners)
        .when((shape == "bezier") & (F.size(m["points"]) >= 3) & all_real, bezier(m["points"]))
        .when((shape == "text") & inside(s["x"]) & inside(s["y"]) & inside(e["x"]) & inside(e["y"]) & m["text"].isNotNull(), text)
    )


def bezier(points: Column, samples: int = 5) -> Column:
    """A closed curve of quadratic pieces through every other point, sampled; an odd last point is kept as it is."""

    def piece(i: Column) -> Column:
        a, c = F.get(points, 2 * i), F.get(points, 2 * i + 1)
        n = F.size(points)
        b = F.get(points, F.when(2 * i + 2 < n, 2 * i + 2).otherwise(0))
        at = lambda t, k: a[k] * (1 - t) * (1 - t) + c[k] * 2 * t * (1 - t) + b[k] * t * t
        steps = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda j: j / F.lit(float(samples)))
        whole = F.flatten(F.transform(steps, lambda t: F.array(at(t, "x"), at(t, "y"))))
        return F.when(c.isNull(), F.array(a["x"], a["y"])).otherwise(whole)

    last = F.ceil(F.size(points) / 2).cast("int") - 1
    return F.flatten(F.transform(F.sequence(F.lit(0), last), piece))


def newly_retired(counts: DataFrame, new: DataFrame) -> DataFrame:
    """``subject_id, workflow_id`` of ``counts`` with rows in ``new`` that were retired no earlier than the first of ``new``."""
    keys = ["subject_id", "workflow_id"]
    since = new.agg(F.min("created_at").alias("since"))
    done = counts.where("retired_at IS NOT NULL").crossJoin(F.broadcast(since)).where("retired_at >= since")  # one row
    return done.select(*keys).join(new.select(*keys).distinct(), keys, "left_semi")


def within_image(marked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks without the lines and rectangles that reach beyond their image (``subject_id, height, width``); unknown sizes bound nothing."""
    p = lambda i: F.get("params", F.lit(i))
    beyond = (F.greatest(p(0), p(2)) > F.col("width")) | (F.greatest(p(1), p(3)) > F.col("height"))
    out = marked.join(sizes.select("subject_id", "height", "width").where("subject_id IS NOT NULL").dropDuplicates(["subject_id"]), "subject_id", "left")
    kept = ~F.col("shape").isin("line", "rectangle", "image") | ~F.coalesce(beyond, F.lit(False))
    return out.where(kept).select(*marked.columns)


def answers_order(workflows: DataFrame, question: str) -> DataFrame:
    """``workflow_id, answer, pos``: the answers to a survey question in the order the workflow gives them, from 1."""
    parsed = F.expr("try_variant_get(try_parse_json(tasks), '$', 'map<string, variant>')")
    tasks = workflows.select(F.col("id").alias("workflow_id"), F.explode(parsed).alias("task", "t"))
    order = F.expr(f"try_variant_get(t, '$.questions.{question}.answersOrder', 'array<string>')")
    rows = tasks.select("workflow_id", F.posexplode(order).alias("pos", "answer"))
    return rows.groupBy("workflow_id", "answer").agg((F.min("pos") + 1).alias("pos"))


def saw_nothing(rows: DataFrame, marked: DataFrame, tool_shapes: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, task, shape, volunteer`` of those who did a drawing task without marking a shape of it."""
    did = task_entries(rows).where("value IS NOT NULL").select("workflow_id", "subject_id", "task", "volunteer").distinct()
    shapes = tool_shapes.select("workflow_id", "task", "shape").distinct()
    made = marked.select("workflow_id", "subject_id", "task", "shape", "volunteer").distinct()
    return did.join(F.broadcast(shapes), ["workflow_id", "task"]).join(made, ["workflow_id", "subject_id", "task", "shape", "volunteer"], "left_anti")
