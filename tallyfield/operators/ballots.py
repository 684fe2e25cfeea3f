"""Ballots: one volunteer's answer to one question about one subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.annotations import task_ballot
from ..functions.identity import user_key


def first_questions(workflows: DataFrame) -> DataFrame:
    """``workflow_id, task, n_answers`` of the workflows that open with a question with one answer."""
    entry = F.expr("try_variant_get(try_parse_json(tasks), '$', 'map<string, variant>')[first_task]")
    return (
        workflows.select(F.col("id").alias("workflow_id"), F.col("first_task").alias("task"), entry.alias("t"))
        .where("try_variant_get(t, '$.type', 'string') = 'single'")
        .select("workflow_id", "task", F.expr("size(try_variant_get(t, '$.answers', 'array<variant>'))").alias("n_answers"))
        .where("n_answers > 0")
    )


def ballots(classifications: DataFrame, questions: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, task, n_answers, user_key, answer``: the valid ballot with the highest id.

    ``questions`` has ``workflow_id, task, n_answers``, one row for each workflow of the project, which is what
    bounds the broadcast. Rows without a valid ballot, a volunteer, a subject or a workflow give no ballot;
    repeated deliveries change nothing; empty tables give an empty result; other columns are ignored.
    """
    rows = classifications.select(
        "id", "workflow_id", F.col("subject_id").cast("long").alias("subject_id"), user_key().alias("user_key"), "annotations"
    )
    answer = task_ballot(F.col("annotations"), F.col("task"), F.col("n_answers"))
    keys = ["workflow_id", "subject_id", "task", "n_answers", "user_key"]
    return (
        rows.where("user_key IS NOT NULL AND subject_id IS NOT NULL AND annotations IS NOT NULL")
        .join(F.broadcast(questions), "workflow_id")
        .select(*keys, "id", answer.alias("answer"))
        .where("answer IS NOT NULL")
        .groupBy(*keys)
        .agg(F.max_by("answer", "id").alias("answer"))
    )
