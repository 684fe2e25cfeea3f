"""Queries p2, p4 and p5: sessions, balanced per-key results, nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotations import task_ballot
from ..functions.identity import user_key
from ..operators import dewey, sessions, skew
from ..operators.ballots import first_questions
from ..sources.tables import table
from .reference import KEY_SQL, ONCE_SQL, TASKS_SQL

GAP_US = 15 * 60 * 1_000_000
HEAVY_SHARE = 0.02


def p2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "classifications").select(
        "id", user_key().alias("user_key"), F.unix_micros("created_at").alias("at_us")
    )
    return sessions.sessions(rows, "user_key", "at_us", GAP_US, "id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_sessions(spark, folder).select("user_key", "start_us", "end_us")


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(k).alias("key_field"), F.col(k).cast("long").alias("key_value")) for k in ("subject_id", "workflow_id")))
    return rows.select(F.explode(keys).alias("key"), *columns).select("key.*", *columns)


def p4_key_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, volunteers and answers to the first question of every subject and workflow, heavy keys marked."""
    questions = first_questions(table(spark, folder, "workflows"))
    rows = (
        table(spark, folder, "classifications")
        .join(F.broadcast(questions), "workflow_id", "left")  # one row for each workflow of the project
        .select(
            "subject_id", "workflow_id", user_key().alias("user_key"),
            task_ballot(F.col("annotations"), F.col("task"), F.col("n_answers")).alias("answer"),
        )
    )
    counts = table(spark, folder, "subject_workflow_counts").where("subject_id IS NOT NULL")
    side = (
        counts.groupBy(F.lit("subject_id").alias("key_field"), F.col("subject_id").alias("key_value"))
        .agg(F.when(F.count("retired_at") == F.count(F.lit(1)), "retired").otherwise("active").alias("label"))
        .unionByName(
            table(spark, folder, "workflows").select(
                F.lit("workflow_id").alias("key_field"), F.col("id").cast("long").alias("key_value"),
                F.col("display_name").alias("label"),
            )
        )
    )
    keyed = _keyed(rows, "user_key", "answer")
    total = table(spark, folder, "classifications").count()
    out = skew.per_key_results(keyed, side, value="answer")
    return out.select(
        "key_field", "key_value", "rows", F.col("members").alias("volunteers"), "label",
        F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("answers"),
        (F.col("rows") >= HEAVY_SHARE * total).alias("heavy"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "classifications").select("subject_id", "workflow_id", user_key().alias("user_key"))
    total = rows.count()
    out = skew.per_key_results(_keyed(rows, "user_key"))
    return out.where((F.col("rows") >= HEAVY_SHARE * total) & F.col("key_value").isNotNull()).select("key_field", "key_value")


def p5_flat(spark: SparkSession, folder: str, *levels: str, keep_values: bool = True) -> DataFrame:
    return dewey.flat_tables(table(spark, folder, "classifications"), levels, keep_values)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = p5_flat(spark, folder, "follow_ups", keep_values=False)
    return rows.select("id", "task", "item_pos", "child").distinct()


def p5_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return p5_flat(spark, folder, "tasks").select("id", "dewey", "parent", "task", "item_pos", "value")


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    return p5_flat(spark, folder, "items").select("id", "dewey", "parent", "task", "item_pos")


def p5_follow_ups(spark: SparkSession, folder: str) -> DataFrame:
    return p5_flat(spark, folder, "follow_ups").select("id", "dewey", "parent", "task", "item_pos", "child")


def p5_workflow_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of ``workflows.tasks``."""
    return dewey.dewey_nodes(table(spark, folder, "workflows"), "id", "tasks")


def p5_metadata_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of ``subjects.metadata``."""
    return dewey.dewey_nodes(table(spark, folder, "subjects"), "id", "metadata")


QUERIES = {
    "p2_found": p2_found,
    "p2_sessions": p2_sessions,
    "p4_found": p4_found,
    "p4_key_results": p4_key_results,
    "p5_found": p5_found,
    "p5_tasks": p5_tasks,
    "p5_items": p5_items,
    "p5_follow_ups": p5_follow_ups,
    "p5_workflow_nodes": p5_workflow_nodes,
    "p5_metadata_nodes": p5_metadata_nodes,
}


# ---- the same in SQL for DuckDB ----

_EVENTS = f"""{ONCE_SQL}, ev AS (SELECT user_key, epoch_us(created_at) AS t FROM once WHERE user_key IS NOT NULL AND created_at IS NOT NULL),
    marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_key ORDER BY t) <= {GAP_US} THEN 0 ELSE 1 END AS fresh FROM ev),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM marked),
    sittings AS (SELECT user_key, min(t) AS start_us, max(t) AS end_us, count(*) AS events FROM numbered GROUP BY user_key, n)"""
_KEYED = """keyed AS (SELECT 'subject_id' AS key_field, subject_id AS key_value, {rest} FROM {source} UNION ALL
    SELECT 'workflow_id', CAST(workflow_id AS BIGINT), {rest} FROM {source})"""
_NAMED = f"named AS (SELECT *, {KEY_SQL} AS user_key FROM classifications)"
_PLAIN = "CASE WHEN ltrim(annotations) LIKE '\"%' THEN CAST(annotations AS JSON)->>'$' ELSE annotations END"
_BALLOT = """CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]*)?$') AND CAST(v AS DOUBLE) >= 0 AND CAST(v AS DOUBLE) < n_answers
    AND CAST(v AS DOUBLE) = floor(CAST(v AS DOUBLE)) THEN CAST(CAST(v AS DOUBLE) AS INT) END"""
_ANSWERS = f"""{_NAMED}, {TASKS_SQL}, q AS (SELECT w.id AS workflow_id, w.first_task AS task, t.n_answers FROM workflows w JOIN tasks t ON t.workflow_id = w.id AND t.task = w.first_task WHERE t.type = 'single'),
    said AS (SELECT n.subject_id, n.workflow_id, n.user_key, q.n_answers, list_filter(CAST({_PLAIN} AS JSON[]), lambda e: (e->>'task') = q.task)[-1]->>'value' AS v
      FROM named n LEFT JOIN q USING (workflow_id)), answered AS (SELECT *, {_BALLOT} AS answer FROM said)"""
_ITEMS = f"""{ONCE_SQL}, top AS (SELECT id, unnest(CAST({_PLAIN} AS JSON[])) AS e, generate_subscripts(CAST({_PLAIN} AS JSON[]), 1) - 1 AS i FROM once WHERE annotations IS NOT NULL),
    level1 AS (SELECT id, CAST(i AS VARCHAR) AS dewey, NULL AS parent, e->>'task' AS task, e->'value' AS value FROM top WHERE json_type(e) = 'OBJECT'),
    inner1 AS (SELECT id, dewey, task, unnest(CAST(value AS JSON[])) AS x, generate_subscripts(CAST(value AS JSON[]), 1) - 1 AS n FROM level1 WHERE json_type(value) = 'ARRAY'),
    level2 AS (SELECT id, dewey || '.' || n AS dewey, dewey AS parent, x->>'task' AS task, x->'value' AS value, n AS item_pos FROM inner1 WHERE json_exists(x, '$.task')),
    tasks AS (SELECT id, dewey, CAST(NULL AS VARCHAR) AS parent, task, value, CAST(NULL AS BIGINT) AS item_pos FROM level1 UNION ALL SELECT id, dewey, parent, task, value, item_pos FROM level2),
    inner2 AS (SELECT id, dewey, task, unnest(CAST(value AS JSON[])) AS x, generate_subscripts(CAST(value AS JSON[]), 1) - 1 AS n FROM level2 WHERE json_type(value) = 'ARRAY'),
    items AS (SELECT id, dewey || '.' || n AS dewey, dewey AS parent, task, CAST(n AS INT) AS item_pos, x FROM (SELECT * FROM inner1 UNION ALL SELECT * FROM inner2)
      WHERE json_type(x) <> 'NULL' AND NOT json_exists(x, '$.task')),
    follow AS (SELECT id, dewey || '.' || k AS dewey, dewey AS parent, task, item_pos, CAST(k AS VARCHAR) AS child FROM (
        SELECT id, dewey, task, item_pos, unnest(CAST(x->'details' AS JSON[])) AS d, generate_subscripts(CAST(x->'details' AS JSON[]), 1) - 1 AS k FROM items WHERE json_type(x->'details') = 'ARRAY') WHERE json_type(d) = 'OBJECT'
      UNION ALL SELECT id, dewey || '.' || (k + CASE WHEN json_type(x->'details') = 'ARRAY' THEN json_array_length(x->'details') ELSE 0 END), dewey, task, item_pos, child FROM (
        SELECT id, dewey, task, item_pos, x, unnest(json_keys(x->'answers')) AS child, generate_subscripts(json_keys(x->'answers'), 1) - 1 AS k FROM items WHERE json_type(x->'answers') = 'OBJECT'))"""



def _nodes_sql(source: str, column: str) -> str:
    """Every node of a JSON column, level by level."""
    inside = """unnest(CASE WHEN json_type(x) = 'OBJECT' THEN list_transform(json_keys(x), lambda k: {'name': k, 'x': x->k}) ELSE list_transform(TRY_CAST(x AS JSON[]), lambda e: {'name': CAST(NULL AS VARCHAR), 'x': e}) END) AS c,
        generate_subscripts(CASE WHEN json_type(x) = 'OBJECT' THEN json_keys(x) ELSE list_transform(TRY_CAST(x AS JSON[]), lambda e: '') END, 1) - 1 AS k"""
    step = "CASE WHEN c.name IS NULL THEN schema_path || '[]' ELSE schema_path || '.' || c.name END"
    return f"""WITH RECURSIVE roots AS (SELECT id, CAST(CASE WHEN ltrim({column}) LIKE '"%' THEN CAST({column} AS JSON)->>'$' ELSE {column} END AS JSON) AS x, '$' AS schema_path FROM {source} WHERE {column} IS NOT NULL),
        nodes AS (SELECT id, CAST(k AS VARCHAR) AS dewey, CAST(NULL AS VARCHAR) AS parent, {step} AS schema_path, k AS ordinal, c.name AS name, c.x AS x FROM (SELECT *, {inside} FROM roots)
          UNION ALL SELECT id, dewey || '.' || k, dewey, {step}, k, c.name, c.x FROM (SELECT *, {inside} FROM nodes WHERE json_type(x) IN ('OBJECT', 'ARRAY')))
        SELECT id, dewey, parent, schema_path, CAST(ordinal AS INT) AS ordinal, name, CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
        CASE WHEN json_type(x) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE x->>'$' END AS value FROM nodes"""


SQL = {
    "p5_workflow_nodes": _nodes_sql("(SELECT CAST(id AS BIGINT) AS id, tasks FROM workflows)", "tasks"),
    "p5_metadata_nodes": _nodes_sql("subjects", "metadata"),
    "p2_found": f"WITH {_EVENTS} SELECT user_key, start_us, end_us FROM sittings",
    "p2_sessions": f"WITH {_EVENTS} SELECT user_key, start_us, end_us, end_us - start_us AS duration_us, events FROM sittings",
    "p4_found": f"""WITH {_KEYED.format(rest="1 AS one", source="classifications")} SELECT key_field, key_value FROM keyed WHERE key_value IS NOT NULL
        GROUP BY ALL HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM classifications)""",
    "p4_key_results": f"""WITH {_ANSWERS}, {_KEYED.format(rest="user_key, answer", source="answered")},
        tally AS (SELECT key_field, key_value, string_agg(answer || ':' || n, ',' ORDER BY answer) AS answers FROM (SELECT key_field, key_value, answer, count(*) AS n FROM keyed WHERE answer IS NOT NULL GROUP BY ALL) GROUP BY ALL),
        side AS (SELECT 'subject_id' AS key_field, subject_id AS key_value, CASE WHEN count(retired_at) = count(*) THEN 'retired' ELSE 'active' END AS label FROM subject_workflow_counts GROUP BY subject_id
          UNION ALL SELECT 'workflow_id', CAST(id AS BIGINT), display_name FROM workflows),
        total AS (SELECT key_field, key_value, count(*) AS rows, count(DISTINCT user_key) AS volunteers FROM keyed GROUP BY ALL)
        SELECT key_field, key_value, rows, volunteers, label, answers, rows >= {HEAVY_SHARE} * (SELECT count(*) FROM classifications) AS heavy
        FROM total LEFT JOIN side USING (key_field, key_value) LEFT JOIN tally USING (key_field, key_value)""",
    "p5_found": f"WITH {_ITEMS} SELECT DISTINCT id, task, item_pos, child FROM follow",
    "p5_tasks": f"""WITH {_ITEMS} SELECT id, dewey, parent, task, CAST(item_pos AS INT) AS item_pos, CASE WHEN json_type(value) IN ('ARRAY', 'OBJECT') THEN NULL ELSE value->>'$' END AS value FROM tasks""",
    "p5_items": f"WITH {_ITEMS} SELECT id, dewey, parent, task, item_pos FROM items",
    "p5_follow_ups": f"WITH {_ITEMS} SELECT id, dewey, parent, task, item_pos, child FROM follow",
}
