"""Queries of the consensus operators over the project's tables, with SQL for DuckDB that states the same results.

The SQL reads whole tables. Shares and other fractions are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import WHITE_SPACE, user_key
from ..operators import ballots as ballots_op
from ..operators import classify, evaluate, ingest, markings, reliability, scoring, store, survey, text
from ..operators.dedup import anonymous_keys
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c):
    """Rounded to the six digits that are compared."""
    return F.round(c, 6)


# ---- views, in Spark and in SQL ----

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
KEY_SQL = f"CASE WHEN length(trim(user_name, {_BLANKS})) > 0 THEN lower(trim(user_name, {_BLANKS})) ELSE user_ip END"
ONCE_SQL = f"""once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {KEY_SQL} AS user_key,
    row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM classifications) WHERE rn = 1)"""
LATEST_SQL = """latest AS (SELECT * EXCLUDE (rn), coalesce(user_id, -id) AS volunteer FROM (SELECT *,
    row_number() OVER (PARTITION BY workflow_id, subject_id, workflow_version, user_id, user_ip ORDER BY id DESC) AS rn
    FROM (SELECT DISTINCT * FROM classifications)) WHERE rn = 1)"""


def entries_sql(source: str) -> str:
    plain = "CASE WHEN ltrim(annotations) LIKE '\"%' THEN CAST(annotations AS JSON)->>'$' ELSE annotations END"
    return f"""entries AS (SELECT * EXCLUDE (e), e->>'task' AS task, CASE WHEN json_type(e->'value') = 'NULL' THEN NULL ELSE e->'value' END AS value
    FROM (SELECT * EXCLUDE (annotations, metadata), unnest(CAST({plain} AS JSON[])) AS e FROM {source} WHERE annotations IS NOT NULL))"""


TASKS_SQL = """tasks AS (SELECT workflow_id, task, t->>'type' AS type, coalesce(t->>'question', t->>'instruction') AS question,
    coalesce(json_array_length(t->'answers'), 0) AS n_answers, coalesce(json_array_length(t->'tools'), 0) AS n_tools
    FROM (SELECT id AS workflow_id, task, CAST(tasks AS JSON)->task AS t FROM (SELECT id, tasks, unnest(json_keys(tasks)) AS task FROM workflows)))"""
# numeric text counts as its number, like in the ballots of first questions
INDEX_SQL = "CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+(\\.[0-9]*)?$') AND CAST({x} AS DOUBLE) BETWEEN 0 AND n_answers - 1 AND CAST({x} AS DOUBLE) = floor(CAST({x} AS DOUBLE)) THEN CAST(CAST({x} AS DOUBLE) AS INT) END"
BALLOTS_SQL = f"""ballots AS (SELECT e.id, e.workflow_id, e.subject_id, e.task, e.volunteer, t.type, e.value,
    CASE WHEN value IS NULL THEN NULL WHEN json_type(value) = 'ARRAY' THEN list_filter(list_transform(CAST(value AS JSON[]), lambda j: {INDEX_SQL.format(x="(j->>'$')")}), lambda x: x IS NOT NULL)
         ELSE list_filter([{INDEX_SQL.format(x="(value->>'$')")}], lambda x: x IS NOT NULL) END AS choices
    FROM entries e JOIN tasks t USING (workflow_id, task) WHERE t.type IN ('single', 'multiple') AND (value IS NULL OR CAST(value AS VARCHAR) <> '[[]]'))"""
VOTES_SQL = f"""{LATEST_SQL}, {entries_sql("latest")}, {TASKS_SQL}, {BALLOTS_SQL},
    asked AS (SELECT workflow_id, subject_id, task, count(*) AS num_users, sum(coalesce(len(choices), 0)) AS total FROM ballots GROUP BY ALL),
    counted AS (SELECT workflow_id, subject_id, task, answer, count(*) AS votes FROM (SELECT workflow_id, subject_id, task, unnest(choices) AS answer FROM ballots) GROUP BY ALL),
    shares AS (SELECT c.*, c.votes / CAST(a.total AS DOUBLE) AS p, a.num_users FROM counted c JOIN asked a USING (workflow_id, subject_id, task))"""


def latest(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.latest(table(spark, folder, "classifications"), columns=["annotations"])


def ballots(spark: SparkSession, folder: str) -> DataFrame:
    tasks = ingest.workflow_tasks(table(spark, folder, "workflows")).where("type IN ('single', 'multiple')")
    entries = ingest.task_entries(latest(spark, folder)).where("value IS NULL OR value <> '[[]]'")
    joined = entries.join(F.broadcast(tasks), ["workflow_id", "task"])  # a row for each task of the project
    return joined.select("id", "workflow_id", "subject_id", "task", "volunteer", "type", ingest.choices(F.col("value"), F.col("n_answers")).alias("choices"))


def _most_answers(spark: SparkSession, folder: str) -> int:
    """The largest number of answers to a question of the project."""
    return ingest.workflow_tasks(table(spark, folder, "workflows")).agg(F.max("n_answers")).first()[0] or 0


def counted(spark: SparkSession, folder: str) -> DataFrame:
    return classify.vote_count(ballots(spark, folder))


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """``item, user, label``: first answers of volunteers by key, last ballot on a subject."""
    found = ballots_op.ballots(table(spark, folder, "classifications"), ballots_op.first_questions(table(spark, folder, "workflows")))
    return found.select(F.concat_ws(":", "workflow_id", "subject_id").alias("item"), F.col("user_key").alias("user"), F.col("answer").alias("label"))


FIRST_SQL = f"""{ONCE_SQL}, {entries_sql("once")}, {TASKS_SQL}, first_ballots AS (SELECT e.id, e.workflow_id, e.subject_id, e.user_key,
      {INDEX_SQL.format(x="(value->>'$')")} AS answer FROM entries e JOIN workflows w ON w.id = e.workflow_id AND w.first_task = e.task
      JOIN tasks t ON t.workflow_id = e.workflow_id AND t.task = e.task WHERE t.type = 'single' AND value IS NOT NULL AND json_type(value) NOT IN ('ARRAY', 'OBJECT')),
    votes AS (SELECT workflow_id || ':' || subject_id AS item, user_key AS "user", arg_max(answer, id) AS label FROM first_ballots
      WHERE answer IS NOT NULL AND user_key IS NOT NULL GROUP BY workflow_id, subject_id, user_key)"""


# ---- questions ----


@query(f"WITH {VOTES_SQL} SELECT workflow_id, subject_id, task, answer, votes, round(p, 6) AS p, num_users FROM shares")
def vote_share(spark, folder):
    return counted(spark, folder).withColumn("p", r6(F.col("p")))


@query(f"""WITH {VOTES_SQL} SELECT workflow_id, subject_id, task, arg_max(answer, p * 1000000 - answer) AS most_likely, round(max(p), 6) AS p_most_likely,
    round(-sum(p * ln(p)), 6) AS shannon_entropy, round(avg(p), 6) AS mean_agreement, round(median(p), 6) AS median_agreement,
    max(num_users) AS num_users FROM shares GROUP BY workflow_id, subject_id, task""")
def classification_summary(spark, folder):
    out = classify.summary(counted(spark, folder))
    return out.select(*classify.QUESTION, "most_likely", *(r6(F.col(c)).alias(c) for c in ("p_most_likely", "shannon_entropy", "mean_agreement", "median_agreement")), "num_users")


@query(f"""WITH {VOTES_SQL} SELECT workflow_id, subject_id, task, {", ".join(f"round(coalesce(max(p) FILTER (answer = {a}), 0), 6) AS p_{a}" for a in range(6))},
    max(num_users) AS num_users FROM shares GROUP BY workflow_id, subject_id, task""")
def classification_detail(spark, folder):
    answers = range(_most_answers(spark, folder))
    out = classify.detail(counted(spark, folder), list(answers))
    return out.select(*classify.QUESTION, *(r6(F.col(f"p_{a}")).alias(f"p_{a}") for a in answers), "num_users")


@query(f"WITH {VOTES_SQL} SELECT workflow_id, subject_id, task, CASE WHEN coalesce(max(p) FILTER (answer = 0), 0) >= 0.6 THEN 1 ELSE 0 END AS label FROM shares GROUP BY workflow_id, subject_id, task")
def thresholded_majority(spark, folder):
    return classify.thresholded(counted(spark, folder), 0, 0.6)


@query(TASKS_SQL.replace("tasks AS (", "WITH tasks AS (", 1) + " SELECT * FROM tasks")
def workflow_tasks(spark, folder):
    return ingest.workflow_tasks(table(spark, folder, "workflows"))


@query("""SELECT workflow_id, task, CAST(i AS INT) AS answer, replace(CAST(tasks AS JSON)->task->'answers'->CAST(i AS INT)->>'label', '''', '') AS label FROM (
    SELECT workflow_id, tasks, task, unnest(range(CAST(json_array_length(CAST(tasks AS JSON)->task->'answers') AS BIGINT))) AS i
    FROM (SELECT id AS workflow_id, tasks, unnest(json_keys(tasks)) AS task FROM workflows))""")
def answer_labels(spark, folder):
    return ingest.answer_labels(table(spark, folder, "workflows"))


@query("""SELECT workflow_id, task, CAST(i AS INT) AS tool, o->>'type' AS shape, o->>'label' AS label, coalesce(json_array_length(o->'details'), 0) AS n_details FROM (
    SELECT *, CAST(tasks AS JSON)->task->'tools'->CAST(i AS INT) AS o FROM (
    SELECT workflow_id, tasks, task, unnest(range(CAST(json_array_length(CAST(tasks AS JSON)->task->'tools') AS BIGINT))) AS i
    FROM (SELECT id AS workflow_id, tasks, unnest(json_keys(tasks)) AS task FROM workflows)))""")
def drawing_tools(spark, folder):
    return ingest.tools(table(spark, folder, "workflows"))


@query(f"WITH {LATEST_SQL} SELECT workflow_id, subject_id, workflow_version, user_id, user_ip, id FROM latest")
def last_write_wins(spark, folder):
    return latest(spark, folder).select("workflow_id", "subject_id", "workflow_version", "user_id", "user_ip", "id")


@query(f"""WITH {LATEST_SQL}, named AS (SELECT id, workflow_id, subject_id, CASE WHEN user_id IS NULL THEN
    -row_number() OVER (PARTITION BY workflow_id, subject_id, user_id IS NULL ORDER BY id) ELSE user_id END AS user_key FROM latest) SELECT * FROM named""")
def anonymous_user_keys(spark, folder):
    return anonymous_keys(latest(spark, folder).select("id", "workflow_id", "subject_id", "user_id"), ["workflow_id", "subject_id"]).drop("user_id")


@query("""SELECT c.id, c.workflow_id, c.workflow_version, CAST(split_part(c.workflow_version, '.', 1) AS INT) AS major FROM (SELECT DISTINCT * FROM classifications) c
    JOIN workflows w ON w.id = c.workflow_id WHERE split_part(c.workflow_version, '.', 1) = split_part(w.version, '.', 1)""")
def current_major_version(spark, folder):
    current = table(spark, folder, "workflows").select(F.col("id").alias("workflow_id"), ingest.major_version(F.col("version")).alias("wanted"))
    rows = table(spark, folder, "classifications").select("id", "workflow_id", "workflow_version").distinct().withColumn("major", ingest.major_version(F.col("workflow_version")))
    return rows.join(F.broadcast(current), "workflow_id").where("major = wanted").drop("wanted")  # a row for each workflow


@query("""WITH firsts AS (SELECT subject_id, arg_min(coalesce(metadata, 'null'), id) AS metadata FROM (SELECT DISTINCT * FROM classifications) WHERE metadata IS NOT NULL GROUP BY subject_id),
    plain AS (SELECT subject_id, CAST(CASE WHEN ltrim(metadata) LIKE '"%' THEN CAST(metadata AS JSON)->>'$' ELSE metadata END AS JSON)->'subject_dimensions' AS d FROM firsts),
    dims AS (SELECT subject_id, list_filter(CAST(d AS JSON[]), lambda x: (x->>'naturalHeight') IS NOT NULL AND (x->>'naturalWidth') IS NOT NULL) AS l FROM plain)
    SELECT subject_id, CAST(l[-1]->>'naturalHeight' AS DOUBLE) AS height, CAST(l[-1]->>'naturalWidth' AS DOUBLE) AS width FROM dims""")
def subject_dimensions(spark, folder):
    return ingest.subject_dimensions(table(spark, folder, "classifications").where("metadata IS NOT NULL"))


# ---- scores ----

BINS_SQL = f"""{VOTES_SQL}, bins AS (SELECT workflow_id, subject_id, volunteer, CASE WHEN choices[1] = 0 THEN 0 WHEN choices[1] = 1 THEN 1 ELSE 2 END AS bin
    FROM ballots WHERE type = 'single' AND len(choices) > 0)"""


def _bins(spark, folder):
    first = F.get("choices", F.lit(0))
    rows = ballots(spark, folder).where("type = 'single' AND size(choices) > 0")
    return rows.select("workflow_id", "subject_id", "volunteer", F.when(first == 0, 0).when(first == 1, 1).otherwise(2).alias("bin"))


SCORE_SQL = """SELECT workflow_id, subject_id, count(*) FILTER (bin = 0) AS n0, count(*) FILTER (bin = 1) AS n1, count(*) FILTER (bin = 2) AS n2, count(*) AS n,
    round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std FROM (SELECT *, CASE bin WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 ELSE 3.0 END AS w FROM bins) GROUP BY workflow_id, subject_id"""


@query(f"WITH {BINS_SQL} {SCORE_SQL}")
def score_bins(spark, folder):
    out = scoring.accumulate(_bins(spark, folder), ["workflow_id", "subject_id"])
    return out.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


@query(f"WITH {BINS_SQL} {SCORE_SQL}")
def score_bins_merged(spark, folder):
    """The same from counts of two halves, as an accumulator that is resumed."""
    rows = _bins(spark, folder)
    half = F.pmod(F.xxhash64("volunteer"), F.lit(2))
    keys = ["workflow_id", "subject_id"]
    out = scoring.merge_counts(scoring.accumulate(rows.where(half == 0), keys), scoring.accumulate(rows.where(half == 1), keys), keys)
    return out.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


@query("SELECT count(DISTINCT user_id) + count(DISTINCT user_ip) FILTER (user_id IS NULL) AS volunteers, count(*) AS classifications FROM (SELECT DISTINCT * FROM classifications)")
def volunteer_stats(spark, folder):
    rows = table(spark, folder, "classifications").select("id", "user_id", "user_ip").distinct()
    return scoring.volunteers(rows)


# ---- labels and reliability ----


@query(f"WITH {FIRST_SQL} SELECT * FROM votes")
def first_question_votes(spark, folder):
    return votes(spark, folder)


LABELED_SQL = f"""{FIRST_SQL}, n AS (SELECT item, label, count(*) AS n FROM votes GROUP BY ALL), a AS (SELECT item, sum(n) AS total FROM n GROUP BY ALL)"""


@query(f"WITH {LABELED_SQL} SELECT item, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels FROM n JOIN a USING (item) WHERE total >= 10 AND n * 2 >= total GROUP BY item")
def majority_multilabel(spark, folder):
    return classify.majority_labels(votes(spark, folder).withColumn("label", F.col("label").cast("string")), "item", "label")


@query(f"WITH {LABELED_SQL} SELECT item, label, round(n / CAST(total AS DOUBLE), 6) AS share FROM n JOIN a USING (item)")
def vote_distribution(spark, folder):
    return classify.vote_distribution(votes(spark, folder), "item", "label").withColumn("share", r6(F.col("share")))


PLURALITY_SQL = f"""{LABELED_SQL}, plurality AS (SELECT item, label AS true_label FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS r FROM n) WHERE r = 1)"""


@query(f'WITH {PLURALITY_SQL} SELECT "user", count(*) AS n, round(avg(CASE WHEN label = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM votes JOIN plurality USING (item) GROUP BY "user" HAVING count(*) >= 10')
def user_accuracy(spark, folder):
    v = votes(spark, folder)
    return reliability.accuracy_against(v, reliability.plurality(v), 10).withColumn("accuracy", r6(F.col("accuracy")))


@query(f'WITH {PLURALITY_SQL} SELECT "user", true_label, label, count(*) AS n FROM votes JOIN plurality USING (item) GROUP BY ALL')
def confusion_counts(spark, folder):
    v = votes(spark, folder)
    return reliability.confusion_counts(v, reliability.plurality(v))


def _consistency_sql(votes_with_w: str, n: str) -> str:
    return f"""s{n} AS (SELECT item, label, sum(w) AS s FROM {votes_with_w} GROUP BY ALL), t{n} AS (SELECT item, sum(s) AS total, count(*) AS k FROM s{n} GROUP BY ALL HAVING sum(s) > 0),
    c{n} AS (SELECT v.*, (s.s / t.total + (t.k - 1) - (1 - s.s / t.total)) / t.k AS score FROM {votes_with_w} v JOIN s{n} s USING (item, label) JOIN t{n} t USING (item)),
    w{n} AS (SELECT "user", least(1.0, pow(avg(score) / 0.6, 2)) AS weight FROM c{n} GROUP BY ALL)"""


CONSISTENCY_SQL = f"""{FIRST_SQL}, v1 AS (SELECT *, 1.0::DOUBLE AS w FROM votes), {_consistency_sql("v1", "1")},
    v2 AS (SELECT v.item, v."user", v.label, w1.weight AS w FROM votes v JOIN w1 USING ("user")), {_consistency_sql("v2", "2")}"""


@query(f'WITH {CONSISTENCY_SQL} SELECT "user", round(avg(score), 6) AS consistency FROM c1 GROUP BY "user"')
def consistency(spark, folder):
    out = reliability.consistency(votes(spark, folder).withColumn("w", F.lit(1.0))).groupBy("user").agg(F.avg("score").alias("c"))
    return out.select("user", r6(F.col("c")).alias("consistency"))


@query(f'WITH {CONSISTENCY_SQL} SELECT "user", round(weight, 6) AS weight FROM w2')
def consistency_weights(spark, folder):
    return reliability.consistency_weights(votes(spark, folder)).withColumn("weight", r6(F.col("weight")))


@query(f"""WITH {CONSISTENCY_SQL}, r AS (SELECT item, label, round(sum(w), 9) AS s FROM v2 GROUP BY ALL)
    SELECT item, min(label) AS label FROM r JOIN (SELECT item, max(s) AS s FROM r GROUP BY ALL) USING (item, s) GROUP BY item""")
def weighted_revote(spark, folder):
    v = votes(spark, folder)
    once = v.join(reliability.consistency_weights(v, rounds=1), "user").withColumnRenamed("weight", "w")
    sums = once.groupBy("item", "label").agg(F.round(F.sum("w"), 9).alias("w"))
    return reliability.weighted_labels(sums)


@query(f"""WITH {PLURALITY_SQL}, b AS (SELECT true_label AS label, count(*) AS n FROM plurality GROUP BY ALL)
    SELECT CAST(l AS INT) AS label, greatest(1, CAST(floor(coalesce(n, 0) * 100.0 / (SELECT sum(n) FROM b)) AS INT)) AS prior FROM range(6) r(l) LEFT JOIN b ON b.label = l""")
def ibcc_priors(spark, folder):
    return reliability.prior_counts(votes(spark, folder), _most_answers(spark, folder))


@query(f"""WITH {PLURALITY_SQL}, c AS (SELECT true_label, n.label, sum(n / CAST(total AS DOUBLE)) AS s FROM n JOIN a USING (item) JOIN plurality USING (item) GROUP BY ALL),
    t AS (SELECT true_label, sum(s) AS total_s FROM c GROUP BY ALL)
    SELECT CAST(i AS INT) AS true_label, CAST(j AS INT) AS label, greatest(1, CAST(floor(coalesce(s * 60 / total_s, 0) + 1e-9) AS INT)) AS count
    FROM range(6) x(i) CROSS JOIN range(6) y(j) LEFT JOIN c ON c.true_label = i AND c.label = j LEFT JOIN t ON t.true_label = i""")
def ibcc_confusion(spark, folder):
    return reliability.prior_confusion(votes(spark, folder), _most_answers(spark, folder))


@query()
def hard_em(spark, folder):
    return reliability.hard_em(votes(spark, folder), _most_answers(spark, folder))


@query(f"""WITH {PLURALITY_SQL}, s AS (SELECT round(n / CAST(total AS DOUBLE), 3) AS score, CASE WHEN label = true_label THEN 1 ELSE 0 END AS truth FROM n JOIN a USING (item) JOIN plurality USING (item)),
    g AS (SELECT score, sum(truth) AS t, sum(1 - truth) AS f FROM s GROUP BY ALL)
    SELECT score, CAST(sum(t) OVER (ORDER BY score DESC) AS BIGINT) AS cum_t, CAST(sum(f) OVER (ORDER BY score DESC) AS BIGINT) AS cum_f FROM g""")
def roc_curve(spark, folder):
    v = votes(spark, folder)
    shares = classify.vote_distribution(v, "item", "label").join(reliability.plurality(v).withColumnRenamed("label", "true_label"), "item")
    return evaluate.roc(shares.select(F.col("share").alias("score"), (F.col("label") == F.col("true_label")).cast("int").alias("truth")), digits=3)  # as in the SQL


@query(f"""WITH {CONSISTENCY_SQL}, g AS (SELECT round(avg(score), 2) AS value, CASE WHEN count(*) >= 20 THEN 1 ELSE 0 END AS side FROM c1 GROUP BY "user"),
    h AS (SELECT value, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM g GROUP BY ALL),
    c AS (SELECT sum(a) OVER (ORDER BY value) / CAST(sum(a) OVER () AS DOUBLE) - sum(b) OVER (ORDER BY value) / CAST(sum(b) OVER () AS DOUBLE) AS d FROM h)
    SELECT round(max(abs(d)), 6) AS ks FROM c""")
def ks_distance(spark, folder):
    scored = reliability.consistency(votes(spark, folder).withColumn("w", F.lit(1.0))).groupBy("user").agg(F.avg("score").alias("value"), (F.count(F.lit(1)) >= 20).cast("int").alias("side"))
    return evaluate.ks_distance(scored, digits=2).withColumn("ks", r6(F.col("ks")))  # digits as in the SQL


@query(f"""WITH {PLURALITY_SQL} SELECT CAST(label AS INT) AS label, round(avg(-ln(least(greatest(CASE WHEN label = true_label THEN p ELSE 1 - p END, 1e-15), 1 - 1e-15))), 6) AS log_loss
    FROM (SELECT label, true_label, n / CAST(total AS DOUBLE) AS p FROM n JOIN a USING (item) JOIN plurality USING (item)) GROUP BY label""")
def log_loss(spark, folder):
    v = votes(spark, folder)
    shares = classify.vote_distribution(v, "item", "label").join(reliability.plurality(v).withColumnRenamed("label", "true_label"), "item")
    out = evaluate.log_loss(shares.select("label", F.col("share").alias("score"), (F.col("label") == F.col("true_label")).cast("int").alias("truth")), ["label"])
    return out.withColumn("log_loss", r6(F.col("log_loss")))


@query(f"""WITH {PLURALITY_SQL} SELECT "user", count(*) FILTER (label > 0 AND true_label > 0) AS tp, count(*) FILTER (label = 0 AND true_label = 0) AS tn,
    count(*) FILTER (label > 0 AND true_label = 0) AS fp, count(*) FILTER (label = 0 AND true_label > 0) AS fn FROM votes JOIN plurality USING (item) GROUP BY "user" """)
def outcome_counts(spark, folder):
    v = votes(spark, folder)
    both = v.join(reliability.plurality(v).withColumnRenamed("label", "t"), "item")
    return evaluate.outcome_counts(both.select("user", (F.col("label") > 0).cast("int").alias("predicted"), (F.col("t") > 0).cast("int").alias("truth")), ["user"])


@query(f"""WITH {FIRST_SQL}, m AS (SELECT item, "user", label AS own, sum(label) OVER (PARTITION BY item) - label AS s, count(*) OVER (PARTITION BY item) - 1 AS n FROM votes)
    SELECT item, "user", CAST(own AS DOUBLE) AS own, round(CASE WHEN n > 0 THEN s / CAST(n AS DOUBLE) END, 6) AS others FROM m""")
def others_mean(spark, folder):
    return evaluate.others_mean(votes(spark, folder), "item", "user", "label").withColumn("others", r6(F.col("others")))


@query(f'WITH {FIRST_SQL} SELECT item, count(DISTINCT "user") AS users FROM votes GROUP BY item HAVING count(DISTINCT "user") >= 2')
def shared_items(spark, folder):
    return evaluate.shared_items(votes(spark, folder), "item", "user")


@query("""SELECT id, workflow_id, subject_id, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id, subject_id ORDER BY id) AS nth
    FROM (SELECT DISTINCT id, workflow_id, subject_id FROM classifications)) WHERE nth <= 5""")
def first_n_votes(spark, folder):
    rows = table(spark, folder, "classifications").select("id", "workflow_id", "subject_id").distinct()
    return evaluate.first_n(rows, ["workflow_id", "subject_id"], ["id"], 5)


@query("SELECT workflow_id, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n FROM (SELECT DISTINCT id, workflow_id, created_at FROM classifications) WHERE created_at IS NOT NULL GROUP BY ALL")
def daily_counts(spark, folder):
    rows = table(spark, folder, "classifications").select("id", "workflow_id", "created_at").distinct().where("created_at IS NOT NULL")
    return rows.groupBy("workflow_id", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# ---- surveys ----

SURVEY_SQL = f"""{LATEST_SQL}, {entries_sql("latest")}, {TASKS_SQL}, sv AS (SELECT e.workflow_id, e.subject_id, e.volunteer, e.value FROM entries e JOIN tasks t USING (workflow_id, task) WHERE t.type = 'survey'),
    choices AS (SELECT workflow_id, subject_id, volunteer, c->>'choice' AS species, c->'answers' AS answers FROM (
      SELECT workflow_id, subject_id, volunteer, unnest(CAST(value AS JSON[])) AS c FROM sv WHERE json_type(value) = 'ARRAY') WHERE c->>'choice' IS NOT NULL),
    species AS (SELECT workflow_id, subject_id, species, count(*) AS votes FROM choices GROUP BY ALL),
    per_user AS (SELECT workflow_id, subject_id, volunteer, count(*) FILTER (CAST(value AS VARCHAR) <> '[]') AS n FROM sv WHERE value IS NOT NULL AND CAST(value AS VARCHAR) <> '[[]]' GROUP BY ALL),
    seen AS (SELECT workflow_id, subject_id, count(*) AS num_users, median(n) FILTER (n > 0) AS median_species FROM per_user GROUP BY ALL),
    fu AS (SELECT workflow_id, subject_id, species, question, unnest(CASE WHEN json_type(a) = 'ARRAY' THEN CAST(a AS JSON[]) ELSE [a] END)->>'$' AS answer FROM (
      SELECT *, answers->question AS a FROM (SELECT *, unnest(json_keys(answers)) AS question FROM choices WHERE json_type(answers) = 'OBJECT')))"""


def _survey(spark, folder):
    tasks = ingest.workflow_tasks(table(spark, folder, "workflows")).where("type = 'survey'").select("workflow_id", "task")
    return ingest.task_entries(latest(spark, folder)).join(F.broadcast(tasks), ["workflow_id", "task"])  # a row for each task


@query(f"WITH {SURVEY_SQL} SELECT * FROM species")
def species_votes(spark, folder):
    return survey.species_votes(survey.survey_votes(_survey(spark, folder)))


@query(f"""WITH {SURVEY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY workflow_id, subject_id ORDER BY votes DESC, species) AS rank FROM species)
    SELECT workflow_id, subject_id, species, votes, CAST(rank AS INT) AS rank, round(votes / CAST(num_users AS DOUBLE), 6) AS share, num_users FROM r JOIN seen USING (workflow_id, subject_id) WHERE rank <= floor(median_species)""")
def species_top(spark, folder):
    e = _survey(spark, folder)
    return survey.top_species(survey.species_votes(survey.survey_votes(e)), survey.viewers(e)).withColumn("share", r6(F.col("share")))


@query(f"""WITH {SURVEY_SQL} SELECT workflow_id, subject_id, count(*) AS num_species, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS pielou
    FROM (SELECT *, votes / CAST(num_users AS DOUBLE) AS p FROM species JOIN seen USING (workflow_id, subject_id)) GROUP BY workflow_id, subject_id""")
def pielou_evenness(spark, folder):
    e = _survey(spark, folder)
    return survey.pielou(survey.species_votes(survey.survey_votes(e)), survey.viewers(e)).withColumn("pielou", r6(F.col("pielou")))


@query(f"WITH {SURVEY_SQL} SELECT workflow_id, subject_id, species, question, answer, count(*) AS votes FROM fu WHERE answer IS NOT NULL GROUP BY ALL")
def species_follow_ups(spark, folder):
    return survey.follow_up_votes(survey.survey_votes(_survey(spark, folder)))


@query(f"""WITH {SURVEY_SQL}, ordered AS (SELECT w.id AS workflow_id, list_transform(CAST(CAST(w.tasks AS JSON)->t.task->'questions'->'HWMN'->'answersOrder' AS JSON[]), lambda x: x->>'$') AS names FROM workflows w JOIN tasks t ON t.workflow_id = w.id WHERE t.type = 'survey'),
    h AS (SELECT fu.workflow_id, subject_id, species, answer, list_position(o.names, answer) AS pos, count(*) AS votes FROM fu JOIN ordered o USING (workflow_id) WHERE question = 'HWMN' GROUP BY ALL)
    SELECT workflow_id, subject_id, species, arg_min(answer, pos) AS lowest, arg_max(answer, votes * 100 - pos) AS likeliest, round(max(votes) / CAST(sum(votes) AS DOUBLE), 6) AS share,
    arg_max(answer, pos) AS highest FROM h WHERE pos > 0 GROUP BY workflow_id, subject_id, species""")
def how_many(spark, folder):
    out = survey.how_many(survey.follow_up_votes(survey.survey_votes(_survey(spark, folder))), ingest.answers_order(table(spark, folder, "workflows"), "HWMN"))
    return out.withColumn("share", r6(F.col("share")))


@query(f"""WITH {SURVEY_SQL} SELECT workflow_id, subject_id, volunteer, string_agg(DISTINCT species, '_' ORDER BY species) AS labels FROM choices GROUP BY ALL""")
def user_species_set(spark, folder):
    v = survey.survey_votes(_survey(spark, folder)).withColumn("item", F.struct("workflow_id", "subject_id"))
    return classify.label_sets(v, "item", "volunteer", "species").select("item.workflow_id", "item.subject_id", "volunteer", "labels")


# ---- marks ----


def marks(spark, folder):
    return ingest.marks(latest(spark, folder), ingest.tools(table(spark, folder, "workflows")))


def _members(spark, folder, shapes: tuple[str, ...], kernel: str = "agglomerative"):
    return markings.cluster_marks(marks(spark, folder).where(F.col("shape").isin(*shapes)), kernel)


@query()
def point_clusters(spark, folder):
    return markings.cluster_summary(_members(spark, folder, ("point",)))


@query()
def ellipse_circle_clusters(spark, folder):
    return markings.cluster_summary(_members(spark, folder, ("ellipse", "circle")))


@query()
def rectangle_clusters(spark, folder):
    return markings.cluster_summary(_members(spark, folder, ("rectangle",)))


@query()
def line_clusters(spark, folder):
    return markings.cluster_summary(_members(spark, folder, ("line",)))


@query()
def split_click_clusters(spark, folder):
    return markings.cluster_summary(_members(spark, folder, ("rectangle",), "split_clicks"))


@query()
def medoid_clusters(spark, folder):
    return markings.cluster_summary(_members(spark, folder, ("line",), "medoids"))


@query()
def existence_probability(spark, folder):
    members = _members(spark, folder, ("point",))
    did = ingest.task_entries(latest(spark, folder)).where("value IS NOT NULL").select("workflow_id", "subject_id", "task", F.col("volunteer").cast("string").alias("volunteer"))
    return classify.existence(members, did, ["workflow_id", "subject_id", "task"], "cluster")


@query()
def most_likely_tool(spark, folder):
    return classify.most_likely_tool(_members(spark, folder, ("point",)), [*markings.GROUP, "cluster"])


@query()
def follow_up_votes(spark, folder):
    """Answers to the questions of a cluster's likeliest tool."""
    from ..operators.dewey import flat_tables

    members = _members(spark, folder, ("point",))
    tool = classify.most_likely_tool(members, [*markings.GROUP, "cluster"]).drop("p_tool")
    mine = members.join(tool, [*markings.GROUP, "cluster", "tool"])
    said = flat_tables(latest(spark, folder), ("follow_ups",)).select("id", "task", F.col("item_pos").alias("item"), F.col("child").alias("follow_up"), "value")
    rows = mine.join(said, ["id", "task", "item"]).select("workflow_id", "subject_id", "task", "cluster", "follow_up", ingest.choices(F.col("value"), F.lit(1000)).alias("choices"))
    return classify.vote_count(rows, ["workflow_id", "subject_id", "task", "cluster", "follow_up"])


@query()
def polygon_consensus(spark, folder):
    return markings.polygon_consensus(marks(spark, folder))


# ---- transcriptions ----


@query()
def line_consensus(spark, folder):
    return text.consensus_lines(text.lines(marks(spark, folder)))


@query()
def connected_transcriptions(spark, folder):
    return text.connected_lines(marks(spark, folder))


@query("""SELECT id, regexp_replace(replace(display_name, ' ', '_'), '[^A-Za-z0-9_]', '', 'g')[1:50] AS name, levenshtein(login, coalesce(display_name, '')) AS edits FROM users""")
def user_labels(spark, folder):
    users = table(spark, folder, "users")
    return users.select("id", text.label_text(F.col("display_name")).alias("name"), F.levenshtein("login", F.coalesce("display_name", F.lit(""))).alias("edits"))


# ---- joins, storing, sets ----


@query("""SELECT s.id AS subject_id, c.workflow_id, s.metadata IS NOT NULL AS described FROM subjects s JOIN subject_workflow_counts c ON c.subject_id = s.id WHERE c.retired_at IS NOT NULL""")
def retired_subject_metadata(spark, folder):
    counts = table(spark, folder, "subject_workflow_counts").where("retired_at IS NOT NULL")
    return counts.join(table(spark, folder, "subjects").withColumnRenamed("id", "subject_id"), "subject_id").select("subject_id", "workflow_id", F.col("metadata").isNotNull().alias("described"))


@query(f"""WITH {VOTES_SQL}, old AS (SELECT workflow_id, subject_id, task, answer, CAST(0 AS BIGINT) AS votes FROM shares),
    new AS (SELECT workflow_id, subject_id, task, answer, votes FROM shares WHERE votes >= 3)
    SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.workflow_id = o.workflow_id AND n.subject_id = o.subject_id AND n.task = o.task AND n.answer = o.answer)""")
def upsert_merge(spark, folder):
    c = counted(spark, folder).select("workflow_id", "subject_id", "task", "answer", "votes")
    return store.upsert(c.withColumn("votes", F.lit(0).cast("long")), c.where("votes >= 3"), ["workflow_id", "subject_id", "task", "answer"])


@query("""SELECT DISTINCT subject_id FROM classifications WHERE gold_standard UNION SELECT subject_id FROM subject_workflow_counts WHERE retired_at IS NOT NULL
    EXCEPT SELECT id FROM subjects WHERE metadata IS NULL""")
def subject_sets(spark, folder):
    gold = table(spark, folder, "classifications").where("gold_standard").select("subject_id")
    done = table(spark, folder, "subject_workflow_counts").where("retired_at IS NOT NULL").select("subject_id")
    plain = table(spark, folder, "subjects").where("metadata IS NULL").select(F.col("id").alias("subject_id"))
    return gold.union(done).distinct().subtract(plain)


@query(f"""WITH {ONCE_SQL} SELECT o.user_key, u.display_name, count(*) AS n FROM once o JOIN users u ON u.id = o.user_id GROUP BY ALL""")
def user_display_names(spark, folder):
    once = table(spark, folder, "classifications").select("id", "user_id", user_key().alias("user_key")).dropDuplicates(["id"])
    return once.join(table(spark, folder, "users").withColumnRenamed("id", "user_id"), "user_id").groupBy("user_key", "display_name").agg(F.count(F.lit(1)).alias("n"))


