"""Queries on marks, surveys and transcriptions that SQL can state: marks themselves, links between them, reports of clusters.

The SQL reads whole tables; clusters are those of friends of friends, which SQL finds by reachability.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, evaluate, ingest, markings, reliability, store, survey, text, transcribe
from ..operators.dewey import flat_tables
from ..sources.tables import table
from .reference import FIRST_SQL, LATEST_SQL, PLURALITY_SQL, SURVEY_SQL, TASKS_SQL, VOTES_SQL, _survey, counted, entries_sql, latest, marks, query, r6, votes

KEY = ["workflow_id", "subject_id", "task"]


def _number(at: str) -> str:
    return f"CASE WHEN json_type({at}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN CAST({at}->>'$' AS DOUBLE) END"


_FIELDS = ", ".join(_number(f"j->'{f}'") + f" AS {f}" for f in ("x", "y", "x1", "y1", "x2", "y2", "width", "height", "r", "rx", "ry", "angle"))
_ENDS = ", ".join(_number(f"j->'{e}'->'{c}'") + f" AS {n}{c}" for e, n in (("startPoint", "s"), ("endPoint", "e")) for c in "xy")
_IN = "({0} BETWEEN 0 AND 100000)"
MARKS_SQL = f"""{LATEST_SQL}, {entries_sql("latest")},
    tools AS (SELECT workflow_id, task, CAST(i AS INT) AS tool, o->>'type' AS shape FROM (SELECT *, CAST(tasks AS JSON)->task->'tools'->CAST(i AS INT) AS o FROM (
      SELECT workflow_id, tasks, task, unnest(range(CAST(json_array_length(CAST(tasks AS JSON)->task->'tools') AS BIGINT))) AS i FROM (SELECT id AS workflow_id, tasks, unnest(json_keys(tasks)) AS task FROM workflows)))),
    lists AS (SELECT id, workflow_id, subject_id, volunteer, task, value FROM entries WHERE json_type(value) = 'ARRAY' UNION ALL
      SELECT id, workflow_id, subject_id, volunteer, e->>'task', e->'value' FROM (SELECT *, unnest(CAST(value AS JSON[])) AS e FROM entries WHERE json_type(value) = 'ARRAY')
      WHERE json_type(e) = 'OBJECT' AND e->>'task' IS NOT NULL AND json_type(e->'value') = 'ARRAY'),
    objects AS (SELECT * FROM (SELECT id, workflow_id, subject_id, volunteer, task, unnest(CAST(value AS JSON[])) AS j, CAST(generate_subscripts(CAST(value AS JSON[]), 1) - 1 AS INT) AS item FROM lists) WHERE json_type(j) = 'OBJECT'),
    fields AS (SELECT id, workflow_id, subject_id, volunteer, task, item, CASE WHEN json_type(j->'tool') IN ('BIGINT', 'UBIGINT') THEN CAST(j->>'tool' AS INT) END AS own, j->>'type' AS kind, {_FIELDS}, {_ENDS},
      j->>'text' AS text, CASE WHEN json_type(j->'variants') = 'ARRAY' THEN list_transform(CAST(j->'variants' AS JSON[]), lambda v: v->>'$') END AS variants,
      CASE WHEN json_type(j->'points') = 'ARRAY' THEN flatten(list_transform(CAST(j->'points' AS JSON[]), lambda p: [{_number("p->'x'")}, {_number("p->'y'")}])) END AS corners FROM objects),
    named AS (SELECT f.*, t.tool, t.shape FROM fields f JOIN tools t ON t.workflow_id = f.workflow_id AND t.task = f.task AND CASE WHEN own IS NOT NULL THEN own = t.tool ELSE kind = t.shape END
      QUALIFY row_number() OVER (PARTITION BY id, f.task, item ORDER BY t.tool) = 1),
    marks AS (SELECT * FROM (SELECT id, workflow_id, subject_id, volunteer, task, item, tool, shape, text, variants, CASE
      WHEN shape = 'point' AND {_IN.format("x")} AND {_IN.format("y")} THEN [x, y]
      WHEN shape = 'line' AND {" AND ".join(_IN.format(c) for c in ("x1", "y1", "x2", "y2"))} THEN CASE WHEN x1 <= x2 THEN [x1, y1, x2, y2] ELSE [x2, y2, x1, y1] END
      WHEN shape IN ('rectangle', 'image') AND {_IN.format("x")} AND {_IN.format("y")} AND width > 0 AND height > 0 THEN [x, y, x + width, y + height]
      WHEN shape = 'circle' AND x IS NOT NULL AND y IS NOT NULL AND r > 0 THEN [x, y, r]
      WHEN shape = 'ellipse' AND x IS NOT NULL AND y IS NOT NULL AND rx IS NOT NULL AND ry IS NOT NULL AND angle IS NOT NULL THEN [x, y, rx, ry, angle]
      WHEN shape = 'polygon' AND len(corners) >= 6 AND len(list_filter(corners, lambda c: c IS NULL)) = 0 THEN corners
      WHEN shape = 'text' AND {" AND ".join(_IN.format(c) for c in ("sx", "sy", "ex", "ey"))} AND text IS NOT NULL THEN CASE WHEN sx <= ex THEN [sx, ex, sy, ey] ELSE [ex, sx, ey, sy] END
      END AS params FROM named) WHERE params IS NOT NULL)"""

# ---- marks ----


@query(f"""WITH {MARKS_SQL} SELECT id, workflow_id, subject_id, volunteer, task, item, tool, shape, text, len(params) AS n,
    {", ".join(f"round(params[{i + 1}], 6) AS p{i}" for i in range(5))} FROM marks""")
def readable_marks(spark, folder):
    p = (r6(F.get("params", F.lit(i))).alias(f"p{i}") for i in range(5))
    return marks(spark, folder).select("id", "workflow_id", "subject_id", "volunteer", "task", "item", "tool", "shape", "text", F.size("params").alias("n"), *p)


_DIMENSIONS = """firsts AS (SELECT subject_id, arg_min(metadata, id) AS metadata FROM (SELECT DISTINCT * FROM classifications) WHERE metadata IS NOT NULL GROUP BY subject_id),
    sizes AS (SELECT subject_id, CAST(l[-1]->>'naturalHeight' AS DOUBLE) AS height, CAST(l[-1]->>'naturalWidth' AS DOUBLE) AS width FROM (
      SELECT subject_id, list_filter(CAST(CAST(CASE WHEN ltrim(metadata) LIKE '"%' THEN CAST(metadata AS JSON)->>'$' ELSE metadata END AS JSON)->'subject_dimensions' AS JSON[]),
        lambda x: (x->>'naturalHeight') IS NOT NULL AND (x->>'naturalWidth') IS NOT NULL) AS l FROM firsts))"""


@query(f"""WITH {MARKS_SQL}, {_DIMENSIONS} SELECT id, m.subject_id, task, item, shape FROM marks m LEFT JOIN sizes s ON s.subject_id = m.subject_id
    WHERE NOT (shape IN ('line', 'rectangle', 'image') AND coalesce(greatest(params[1], params[3]) > width OR greatest(params[2], params[4]) > height, false))""")
def marks_within_image(spark, folder):
    sizes = ingest.subject_dimensions(table(spark, folder, "classifications").where("metadata IS NOT NULL"))
    return ingest.within_image(marks(spark, folder), sizes).select("id", "subject_id", "task", "item", "shape")


@query(f"""WITH {MARKS_SQL}, did AS (SELECT DISTINCT workflow_id, subject_id, task, volunteer FROM entries WHERE value IS NOT NULL),
    shapes AS (SELECT DISTINCT workflow_id, task, shape FROM tools)
    SELECT workflow_id, subject_id, task, shape, volunteer FROM did JOIN shapes USING (workflow_id, task) EXCEPT SELECT workflow_id, subject_id, task, shape, volunteer FROM marks""")
def saw_nothing_rows(spark, folder):
    rows, shapes = latest(spark, folder), ingest.tools(table(spark, folder, "workflows"))
    return ingest.saw_nothing(rows, ingest.marks(rows, shapes), shapes).select("workflow_id", "subject_id", "task", "shape", "volunteer")


@query(f"""WITH {MARKS_SQL}, each AS (SELECT workflow_id, subject_id, task, tool, volunteer, count(*) AS n FROM marks GROUP BY ALL)
    SELECT workflow_id, subject_id, task, tool, median(n) AS median_marks, round(avg(n), 6) AS mean_marks FROM each GROUP BY ALL""")
def marks_per_user(spark, folder):
    return markings.marks_per_user(marks(spark, folder).where("shape <> 'bezier'")).withColumn("mean_marks", r6(F.col("mean_marks")))


_POINTS = "a{t} AS (SELECT workflow_id, subject_id, id || ':' || item AS pid, params[1] AS x, params[2] AS y FROM marks WHERE shape = 'point' AND tool = {t})"


def _points(spark, folder, tool: int):
    rows = marks(spark, folder).where((F.col("shape") == "point") & (F.col("tool") == tool))
    return rows.select("workflow_id", "subject_id", F.concat_ws(":", "id", "item").alias("pid"), F.get("params", F.lit(0)).alias("x"), F.get("params", F.lit(1)).alias("y"))


@query(f"""WITH {MARKS_SQL}, {_POINTS.format(t=0)}, {_POINTS.format(t=1)}, p AS (SELECT a.workflow_id, a.subject_id, a.pid AS left_id, b.pid AS right_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
      FROM a0 a JOIN a1 b ON a.workflow_id = b.workflow_id AND a.subject_id = b.subject_id AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60),
    n AS (SELECT *, row_number() OVER (PARTITION BY workflow_id, subject_id, left_id ORDER BY d, right_id) AS r1, row_number() OVER (PARTITION BY workflow_id, subject_id, right_id ORDER BY d, left_id) AS r2 FROM p WHERE d <= 60)
    SELECT workflow_id, subject_id, left_id, right_id, round(d, 6) AS d FROM n WHERE r1 = 1 AND r2 = 1""")
def mutual_nearest_marks(spark, folder):
    return evaluate.mutual_nearest(_points(spark, folder, 0), _points(spark, folder, 1), ["workflow_id", "subject_id"], 60.0).withColumn("d", r6(F.col("d")))


@query(f"""WITH {MARKS_SQL}, {_POINTS.format(t=0)}, p AS (SELECT a.workflow_id, a.subject_id, a.pid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
      FROM a0 a JOIN a0 b ON a.workflow_id = b.workflow_id AND a.subject_id = b.subject_id AND a.pid <> b.pid AND abs(a.x - b.x) <= 40 AND abs(a.y - b.y) <= 40)
    SELECT workflow_id, subject_id, pid, round(sum(exp(-d * d / 225) * d) / sum(exp(-d * d / 225)), 6) AS smooth FROM p WHERE d <= 40 GROUP BY ALL""")
def neighbour_smoothing(spark, folder):
    return evaluate.kernel_mean(_points(spark, folder, 0), ["workflow_id", "subject_id"], 40.0, 15.0).withColumn("smooth", r6(F.col("smooth")))


# ---- links: friends of friends, overlapping rectangles ----


def _reach(nodes: str, edges: str) -> str:
    """Every node with the nodes it can reach (itself included), from ``nodes`` (n) and ``edges`` (u, v both ways)."""
    return f"reach AS (SELECT n, n AS m FROM {nodes} UNION SELECT r.n, e.v FROM reach r JOIN {edges} e ON e.u = r.m)"


_FRIENDS = f"""{MARKS_SQL}, pts AS (SELECT row_number() OVER (ORDER BY id, item) AS n, * FROM marks WHERE shape = 'point'),
    near AS (SELECT a.n AS u, b.n AS v FROM pts a JOIN pts b ON a.workflow_id = b.workflow_id AND a.subject_id = b.subject_id AND a.task = b.task AND a.n <> b.n
      AND (a.params[1] - b.params[1]) * (a.params[1] - b.params[1]) + (a.params[2] - b.params[2]) * (a.params[2] - b.params[2]) <= 400),
    {_reach("pts", "near")}, member AS (SELECT p.*, c.k FROM pts p JOIN (SELECT n, min(m) AS k FROM reach GROUP BY n) c USING (n)),
    cluster AS (SELECT k, workflow_id, subject_id, task, min(id) AS first_id, arg_min(item, id * 1000 + item) AS first_item, count(*) AS marks, count(DISTINCT volunteer) AS volunteers,
      round(median(params[1]), 6) AS cx, round(median(params[2]), 6) AS cy FROM member GROUP BY ALL),
    usage AS (SELECT k, arg_max(tool, n * 1000 + tool) AS tool, max(n) / CAST(sum(n) AS DOUBLE) AS p_tool FROM (SELECT k, tool, count(*) AS n FROM member GROUP BY ALL) GROUP BY k),
    viewers AS (SELECT workflow_id, subject_id, task, count(DISTINCT volunteer) AS num_viewers FROM entries WHERE value IS NOT NULL GROUP BY ALL)"""
_FRIENDS = _FRIENDS.replace("latest AS", "RECURSIVE latest AS", 1)


def _friends(spark, folder, kernel: str = "friends"):
    """Members of clusters of points, each cluster named by the id and item of its first mark."""
    members = markings.cluster_marks(marks(spark, folder).where("shape = 'point'"), kernel)
    first = members.groupBy("cluster").agg(F.min(F.struct("id", "item")).alias("f")).select("cluster", F.col("f.id").alias("first_id"), F.col("f.item").alias("first_item"))
    return members.join(first, "cluster")


_CLUSTER_SQL = f"WITH {_FRIENDS} SELECT workflow_id, subject_id, task, first_id, first_item, marks, volunteers, cx, cy FROM cluster"


def _centres(members):
    first = members.groupBy("cluster").agg(F.first("first_id").alias("first_id"), F.first("first_item").alias("first_item"))
    out = markings.cluster_summary(members).join(first, "cluster")
    at = lambda i: r6(F.get("centre", F.lit(i)))
    return out.select(*KEY, "first_id", "first_item", "marks", "volunteers", at(0).alias("cx"), at(1).alias("cy"))


@query(_CLUSTER_SQL)
def friends_clusters(spark, folder):
    return _centres(_friends(spark, folder))


@query(_CLUSTER_SQL)
def dbscan_clusters(spark, folder):
    """With two marks for a core there are no border marks, so the clusters are those of friends of friends."""
    return _centres(_friends(spark, folder, "dbscan"))


def _viewers(spark, folder):
    did = ingest.task_entries(latest(spark, folder)).where("value IS NOT NULL")
    return did.select(*KEY, F.col("volunteer").cast("string").alias("volunteer"))


CLUSTER = [*KEY, "shape", "cluster", "first_id", "first_item"]


@query(f"""WITH {_FRIENDS} SELECT c.workflow_id, c.subject_id, c.task, first_id, first_item, u.tool, cx, cy, round(p_tool, 6) AS p_tool,
    round(c.volunteers / CAST(num_viewers AS DOUBLE), 6) AS p_true_positive, num_viewers FROM cluster c JOIN usage u USING (k) JOIN viewers USING (workflow_id, subject_id, task)""")
def marking_detail(spark, folder):
    """A row for each cluster of points: centre, likeliest tool and its share, how likely it is real, and who could see it."""
    members = _friends(spark, folder)
    out = markings.detail(members, _viewers(spark, folder), CLUSTER)
    at = lambda i: r6(F.get("centre", F.lit(i)))
    return out.select(*KEY, "first_id", "first_item", "tool", at(0).alias("cx"), at(1).alias("cy"), r6(F.col("p_tool")).alias("p_tool"), r6(F.col("p_true_positive")).alias("p_true_positive"), "num_viewers")


@query(f"""WITH {_FRIENDS}, each AS (SELECT c.workflow_id, c.subject_id, c.task, c.volunteers / CAST(num_viewers AS DOUBLE) AS p, p_tool FROM cluster c JOIN usage u USING (k) JOIN viewers USING (workflow_id, subject_id, task))
    SELECT workflow_id, subject_id, task, count(*) AS clusters, round(avg(p), 6) AS mean_true_positive, round(median(p), 6) AS median_true_positive, round(avg(p_tool), 6) AS mean_tool, round(median(p_tool), 6) AS median_tool
    FROM each GROUP BY ALL""")
def marking_summary(spark, folder):
    """A row for each subject: how many clusters, and mean and median of how real they are and how much their tools agree."""
    out = markings.summary(markings.detail(_friends(spark, folder), _viewers(spark, folder), CLUSTER), KEY)
    return out.select(*KEY, "clusters", *(r6(F.col(c)).alias(c) for c in ("mean_true_positive", "median_true_positive", "mean_tool", "median_tool")))


@query(f"""WITH {_FRIENDS}, far AS (SELECT k, m.workflow_id, m.subject_id, m.task, first_id, first_item, sqrt((params[1] - cx) * (params[1] - cx) + (params[2] - cy) * (params[2] - cy)) AS d FROM member m JOIN cluster c USING (k))
    SELECT workflow_id, subject_id, task, first_id, first_item, round(max(d) / avg(d), 6) AS ratio FROM far GROUP BY ALL HAVING avg(d) > 0 AND round(max(d) / avg(d), 6) > 4""")
def outlier_clusters(spark, folder):
    """Clusters with a mark more than four times as far from the centre as the mean."""
    out = markings.outliers(_friends(spark, folder), CLUSTER, 4.0)
    return out.select(*KEY, "first_id", "first_item", r6(F.col("ratio")).alias("ratio"))


@query(f"""WITH {_FRIENDS} SELECT workflow_id, subject_id, tool, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY workflow_id, subject_id) AS DOUBLE), 6) AS share FROM member GROUP BY workflow_id, subject_id, tool""")
def tool_shares(spark, folder):
    """Each tool's share of a subject's points."""
    rows = marks(spark, folder).where("shape = 'point'").withColumn("item", F.struct("workflow_id", "subject_id"))
    out = classify.vote_distribution(rows, "item", "tool")
    return out.select("item.workflow_id", "item.subject_id", "tool", r6(F.col("share")).alias("share"))


_FOLLOW_SQL = f"""{_FRIENDS}, said AS (SELECT o.id, o.task, o.item, CAST(k AS VARCHAR) AS follow_up, d->'value' AS v FROM (
      SELECT id, task, item, unnest(CAST(j->'details' AS JSON[])) AS d, generate_subscripts(CAST(j->'details' AS JSON[]), 1) - 1 AS k FROM objects WHERE json_type(j->'details') = 'ARRAY') o WHERE json_type(d) = 'OBJECT'),
    told AS (SELECT m.workflow_id, m.subject_id, m.task, m.k, follow_up, CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN NULL WHEN json_type(v) = 'ARRAY' THEN list_transform(CAST(v AS JSON[]), lambda x: x->>'$') ELSE [v->>'$'] END AS c
      FROM member m JOIN usage u ON u.k = m.k AND u.tool = m.tool JOIN said s ON s.id = m.id AND s.task = m.task AND s.item = m.item),
    kept AS (SELECT *, list_filter(c, lambda x: regexp_matches(x, '^[0-9]+$')) AS choices FROM told),
    base AS (SELECT workflow_id, subject_id, task, k, follow_up, count(*) AS num_users, sum(coalesce(len(choices), 0)) AS total FROM kept GROUP BY ALL)"""


@query(f"""WITH {_FOLLOW_SQL} SELECT n.workflow_id, n.subject_id, n.task, c.first_id, c.first_item, n.follow_up, CAST(answer AS INT) AS answer, votes, round(votes / CAST(total AS DOUBLE), 6) AS p, num_users FROM (
    SELECT workflow_id, subject_id, task, k, follow_up, answer, count(*) AS votes FROM (SELECT workflow_id, subject_id, task, k, follow_up, unnest(choices) AS answer FROM kept) GROUP BY ALL) n
    JOIN base b USING (workflow_id, subject_id, task, k, follow_up) JOIN cluster c ON c.k = n.k""")
def cluster_follow_ups(spark, folder):
    """Answers to the questions that a cluster's likeliest tool asks."""
    members = _friends(spark, folder)
    tool = classify.most_likely_tool(members, CLUSTER).drop("p_tool")
    said = flat_tables(latest(spark, folder), ("follow_ups",)).select("id", "task", F.col("item_pos").alias("item"), F.col("child").alias("follow_up"), "value")
    rows = members.join(tool, [*CLUSTER, "tool"]).join(said, ["id", "task", "item"])
    keys = [*KEY, "first_id", "first_item", "follow_up"]
    return classify.vote_count(rows.select(*keys, ingest.choices(F.col("value"), F.lit(1000)).alias("choices")), keys).withColumn("p", r6(F.col("p")))


@query(f"""WITH RECURSIVE {MARKS_SQL}, rects AS (SELECT row_number() OVER (ORDER BY id, item) AS n, subject_id, id || ':' || item AS pid, params[1] AS x1, params[2] AS y1, params[3] AS x2, params[4] AS y2 FROM marks WHERE shape = 'rectangle'),
    met AS (SELECT a.n AS u, b.n AS v FROM rects a JOIN rects b ON a.subject_id = b.subject_id AND a.n <> b.n AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2), {_reach("rects", "met")},
    grp AS (SELECT n, count(DISTINCT m) AS members FROM reach GROUP BY n), links AS (SELECT u AS n, count(*) AS links FROM met GROUP BY u)
    SELECT subject_id, pid, members AS group_size, coalesce(links, 0) AS links FROM rects JOIN grp USING (n) LEFT JOIN links USING (n)""")
def rectangle_overlaps(spark, folder):
    """Every rectangle with how many others it overlaps and how many its group of chained overlaps has."""
    rows = marks(spark, folder).where("shape = 'rectangle'")
    corner = {n: F.get("params", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))}
    return evaluate.overlap_groups(rows.select("subject_id", F.concat_ws(":", "id", "item").alias("pid"), *corner.values()), ["subject_id"]).select("subject_id", "pid", "group_size", "links")


# ---- surveys ----


@query(f"""WITH {SURVEY_SQL}, n AS (SELECT workflow_id, subject_id, species, question, answer, count(*) AS votes FROM fu WHERE answer IS NOT NULL GROUP BY ALL)
    SELECT workflow_id, subject_id, species, question, answer, round(votes / CAST(total AS DOUBLE), 6) AS share FROM (SELECT *, sum(votes) OVER w AS total,
    row_number() OVER (PARTITION BY workflow_id, subject_id, species, question ORDER BY votes DESC, answer) AS r FROM n WINDOW w AS (PARTITION BY workflow_id, subject_id, species, question)) WHERE r = 1""")
def species_follow_up_top(spark, folder):
    return survey.top_answer(survey.follow_up_votes(survey.survey_votes(_survey(spark, folder)))).withColumn("share", r6(F.col("share")))


@query(f"""WITH {SURVEY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY workflow_id, subject_id ORDER BY votes DESC, species) AS rank FROM species),
    even AS (SELECT workflow_id, subject_id, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS pielou FROM (SELECT *, votes / CAST(num_users AS DOUBLE) AS p FROM species JOIN seen USING (workflow_id, subject_id)) GROUP BY ALL),
    said AS (SELECT workflow_id, subject_id, species, string_agg(question || '=' || answer || ':' || n, ' ' ORDER BY question, answer) AS answers FROM (SELECT workflow_id, subject_id, species, question, answer, count(*) AS n FROM fu WHERE answer IS NOT NULL GROUP BY ALL) GROUP BY ALL)
    SELECT r.workflow_id, r.subject_id, species, num_users, pielou, round(votes / CAST(num_users AS DOUBLE), 6) AS share, votes, answers FROM r JOIN seen USING (workflow_id, subject_id) JOIN even USING (workflow_id, subject_id)
    LEFT JOIN said USING (workflow_id, subject_id, species) WHERE rank <= floor(median_species)""")
def survey_report(spark, folder):
    """A row for each of a subject's likeliest species: volunteers, evenness, share, votes and the counts of all follow-up answers."""
    votes = survey.survey_votes(_survey(spark, folder))
    out = survey.report(votes, survey.viewers(_survey(spark, folder)))
    return out.withColumn("pielou", r6(F.col("pielou"))).withColumn("share", r6(F.col("share")))


# ---- transcriptions ----


@query(f"""WITH {MARKS_SQL}, v AS (SELECT workflow_id, subject_id, volunteer, unnest(variants) AS variant FROM marks WHERE shape = 'text')
    SELECT v.workflow_id, v.subject_id, trim(variant) AS variant, count(DISTINCT volunteer) AS volunteers FROM v JOIN users u ON u.id = v.volunteer WHERE trim(variant) <> '' AND u.display_name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT volunteer) >= 2""")
def text_variants(spark, folder):
    """Spellings that at least two known volunteers noted on a page."""
    known = table(spark, folder, "users").where("display_name IS NOT NULL").select(F.col("id").alias("volunteer"))
    return text.variants(marks(spark, folder), known, 2)


_CLEAN = r"""trim(regexp_replace(regexp_replace(CASE WHEN contains(text, chr(10)) THEN '' ELSE trim(replace(regexp_replace(text, '(?i)</?br\s*/?>|</?font[^>]*>|&nbsp;?|\?\?\?', '', 'g'), '&amp;', '&')) END,
    '\[/?[a-z]+\]|</?(?:sw-)?[a-z]+>', '', 'g'), '\s+', ' ', 'g'))"""


@query(f"""WITH {MARKS_SQL}, t AS (SELECT workflow_id, subject_id, CAST(round((params[3] + params[4]) / 2 / 15) AS INT) AS line, volunteer, id, params[1] AS x, {_CLEAN} AS text FROM marks WHERE shape = 'text')
    SELECT workflow_id, subject_id, line, volunteer, id, round(x, 6) AS x, text FROM t WHERE text <> ''""")
def transcription_lines(spark, folder):
    return text.lines(marks(spark, folder)).withColumn("x", r6(F.col("x")))


_LEAN = "atan2(abs(params[4] - params[3]), abs(params[2] - params[1]))"
_PAGE_SQL = f"""{MARKS_SQL}, cleaned AS (SELECT *, {_CLEAN} AS said FROM marks WHERE shape = 'text'),
    turned AS (SELECT *, CASE WHEN {_LEAN} < {transcribe.FLAT} OR (len(string_split(said, ' ')) = 1 AND {_LEAN} < {transcribe.LEANING!r}) THEN 'horizontal' ELSE 'vertical' END AS direction FROM cleaned WHERE said <> ''),
    page AS (SELECT workflow_id, subject_id, CAST(round((CASE WHEN direction = 'horizontal' THEN params[3] + params[4] ELSE params[1] + params[2] END) / 2 / 15) AS INT) AS line, direction, volunteer, id, item, said AS text, params FROM turned)"""


@query(f"WITH {_PAGE_SQL} SELECT workflow_id, subject_id, line, direction, CAST(volunteer AS VARCHAR) AS volunteer, id, item, text FROM page")
def page_lines(spark, folder):
    """Every transcription with its line and direction."""
    return transcribe.page_lines(marks(spark, folder)).select(*KEY[:2], "line", "direction", "volunteer", "id", "item", "text")


@query(f"""WITH {_PAGE_SQL} SELECT workflow_id, subject_id, line, direction, count(DISTINCT volunteer) AS volunteers, {", ".join(f"round(median(params[{i + 1}]), 6) AS {n}" for i, n in enumerate(("x1", "x2", "y1", "y2")))}
    FROM page GROUP BY ALL HAVING count(DISTINCT volunteer) >= 3""")
def line_places(spark, folder):
    """Where the lines that three volunteers transcribed lie."""
    rows = transcribe.page_lines(marks(spark, folder)).groupBy(*KEY[:2], "line", "direction")
    return rows.agg(F.count_distinct("volunteer").alias("volunteers"), *(r6(F.median(c)).alias(c) for c in ("x1", "x2", "y1", "y2"))).where("volunteers >= 3")


def _completed(spark, folder):
    return transcribe.completed(transcribe.page_lines(marks(spark, folder)))


@query()
def completed_stretches(spark, folder):
    return _completed(spark, folder)


@query()
def transcription_agreements(spark, folder):
    return transcribe.own_agreements(transcribe.page_lines(marks(spark, folder)))


@query()
def transcribed_pages(spark, folder):
    return transcribe.pages(_completed(spark, folder))


@query()
def page_documents(spark, folder):
    known = table(spark, folder, "users").where("display_name IS NOT NULL").select(F.col("id").alias("volunteer"))
    subjects = table(spark, folder, "subjects").select(F.col("id").alias("subject_id"), "metadata")
    return transcribe.page_documents(_completed(spark, folder), text.variants(marks(spark, folder), known, 2), subjects)


@query()
def text_mark_clusters(spark, folder):
    """Clusters of text marks by all four coordinates, of three volunteers or more."""
    members = markings.cluster_marks(marks(spark, folder).where("shape = 'text'"), "principal")
    return markings.cluster_summary(members).where("volunteers >= 3")


@query()
def polygon_areas(spark, folder):
    return markings.polygon_areas(markings.polygon_consensus(marks(spark, folder)))


# ---- votes over time and thresholds ----


@query(f"""WITH {FIRST_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY "user") AS nth FROM votes)
    SELECT item, min(label) AS label FROM n WHERE nth <= 3 GROUP BY item HAVING count(*) = 3 AND min(label) = max(label)""")
def unanimous_first_votes(spark, folder):
    """Items whose first three votes agree."""
    return classify.running_majority(votes(spark, folder), "item", "user", "label", 3)


@query(f"""WITH {PLURALITY_SQL}, s AS (SELECT floor(n / CAST(total AS DOUBLE) * 20 + 1e-9) AS b, CASE WHEN label = true_label THEN 1 ELSE 0 END AS truth FROM n JOIN a USING (item) JOIN plurality USING (item))
    SELECT round(t / 20.0, 6) AS threshold, count(*) FILTER (truth = 1) AS true_positives, count(*) FILTER (truth = 0) AS false_positives FROM range(21) r(t) LEFT JOIN s ON s.b >= t GROUP BY t""")
def threshold_sweep(spark, folder):
    v = votes(spark, folder)
    shares = classify.vote_distribution(v, "item", "label").join(reliability.plurality(v).withColumnRenamed("label", "true_label"), "item")
    out = reliability.sweep_thresholds(shares.select(F.col("share").alias("score"), (F.col("label") == F.col("true_label")).cast("int").alias("truth")))
    return out.withColumn("threshold", r6(F.col("threshold")))


# ---- stored results and joins ----


@query(f"""WITH {VOTES_SQL}, s AS (SELECT workflow_id, subject_id, task, arg_max(answer, p * 1000000 - answer) AS most_likely, max(num_users) AS num_users FROM shares GROUP BY ALL)
    SELECT workflow_id, subject_id, task, '{{"most_likely":' || most_likely || ',"num_users":' || num_users || '}}' AS result FROM s""")
def result_documents(spark, folder):
    return store.documents(classify.summary(counted(spark, folder)).select(*classify.QUESTION, "most_likely", "num_users"), classify.QUESTION)


@query("""SELECT s.subject_id, s.workflow_id FROM subject_workflow_counts s WHERE s.retired_at >= (SELECT min(created_at) FROM classifications) AND EXISTS (
    SELECT 1 FROM classifications c WHERE c.subject_id = s.subject_id AND c.workflow_id = s.workflow_id)""")
def newly_retired(spark, folder):
    """Subjects with classifications that were retired after the first of these classifications was made."""
    new = table(spark, folder, "classifications").select("subject_id", "workflow_id", "created_at")
    return ingest.newly_retired(table(spark, folder, "subject_workflow_counts"), new)


@query(f"""WITH {LATEST_SQL}, {entries_sql("latest")}, {TASKS_SQL} SELECT workflow_id, task, coalesce(type, '(unknown)') AS type, count(*) AS n FROM entries LEFT JOIN tasks USING (workflow_id, task) GROUP BY ALL""")
def task_routing(spark, folder):
    """Entries by task and kind; tasks that the workflow doesn't have are counted as unknown, not lost."""
    kinds = ingest.workflow_tasks(table(spark, folder, "workflows")).select("workflow_id", "task", "type")
    rows = ingest.task_entries(latest(spark, folder)).join(F.broadcast(kinds), ["workflow_id", "task"], "left")  # a row for each task
    return rows.groupBy("workflow_id", "task", F.coalesce("type", F.lit("(unknown)")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
