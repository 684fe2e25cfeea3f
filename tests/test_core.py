"""Operators against brute force and worked examples on small fixtures."""

import json
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfield.functions.annotations import task_ballot, written_lines
from tallyfield.functions.identity import user_key, version_rank
from tallyfield.functions.text import words
from tallyfield.kernels import cluster as kernels
from tallyfield.operators import classify, evaluate, ingest, markings, reliability, scoring, store, survey, text
from tallyfield.operators.dedup import last_write, one_per_id
from tallyfield.operators.dewey import dewey_nodes, flat_tables, load, parse_deep, walk
from tallyfield.operators.pointers import roots
from tallyfield.operators.sessions import sessions
from tallyfield.operators.skew import PLAN_SCHEMA, assign, per_key_results, shard_plan

GAP = 900


def brute_sessions(rows):
    by, out = defaultdict(set), []
    for k, t, i in rows:
        if k is not None and t is not None:
            by[k].add((t, i))
    for k, events in by.items():
        run = []
        for e in sorted(events, key=lambda e: e[0]):
            if run and e[0] - run[-1][0] > GAP:
                out.append((k, run[0][0], run[-1][0], len(run)))
                run = []
            run.append(e)
        out.append((k, run[0][0], run[-1][0], len(run)))
    return sorted(out)


def test_sessions_match_brute_force_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.4 else f"u{rng.integers(9)}", int(rng.integers(-200_000, 200_000)), n) for n in range(1500)]
    rows += [("exact", 0, 5001), ("exact", GAP, 5002), ("exact", 2 * GAP + 1, 5003), (None, 5, 5004), ("u1", None, 5005), ("edge", -1, 5006), ("edge", 0, 5007)]
    rows += [("chain", 600 * n, 6000 + n) for n in range(300)] + [rows[0], rows[3]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "key string, t long, i long, k string, root int")
    got = sorted(tuple(r) for r in sessions(df, "key", "t", GAP, "i").select("key", "start_us", "end_us", "events").collect())
    assert got == brute_sessions(rows)


def test_sessions_of_nothing(spark):
    df = spark.createDataFrame([], "key string, t long, i long")
    assert sessions(df, "key", "t", GAP, "i").collect() == []
    with pytest.raises(ValueError):
        sessions(df, "key", "t", 0)


def test_per_key_results_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(4000):
        key = 7 if rng.random() < 0.5 else int(rng.integers(100))
        user = "hot" if rng.random() < 0.3 else f"u{rng.integers(50)}"
        rows.append(("subject_id", key if rng.random() > 0.01 else None, user if rng.random() > 0.02 else None, int(rng.integers(3)) if rng.random() > 0.1 else None, "x"))
    df = spark.createDataFrame(rows, "key_field string, key_value long, user_key string, answer int, tasks string")
    side = spark.createDataFrame([("subject_id", 7, "seven"), ("subject_id", 1, None)], "key_field string, key_value long, label string")
    got = {r["key_value"]: r for r in per_key_results(df, side, value="answer", tasks=6).collect()}
    want = defaultdict(list)
    for _, k, u, a, _ in rows:
        want[k].append((u, a))
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k]["rows"] == len(v)
        assert got[k]["members"] == len({u for u, _ in v if u is not None})
        assert sum((got[k]["values"] or {}).values()) == sum(a is not None for _, a in v)
    assert got[7]["label"] == "seven" and got[2]["label"] is None


def test_a_hot_key_is_cut_and_tasks_are_level(spark):
    loads = spark.createDataFrame([("k", 1, 5000), ("k", 2, 900), *(("k", n, 10) for n in range(3, 400))], "key_field string, key_value long, load long")
    plan = {v: t for _, v, t in shard_plan(loads, 8)}
    assert len(plan[1]) >= 8 and len(set(plan[1])) == 8
    assert all(n not in plan for n in range(3, 400))
    assert shard_plan(loads.limit(0), 8) == []


def test_a_hot_null_key_is_cut_too(spark):
    rows = [("k", None, f"u{n}", "x") for n in range(4000)] + [("k", n % 50, f"u{n}", "x") for n in range(4000)]
    df = spark.createDataFrame(rows, "key_field string, key_value long, user_key string, other string")
    loads = df.groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("load"))
    plan = spark.createDataFrame(shard_plan(loads, 8), PLAN_SCHEMA)
    sizes = [r["count"] for r in assign(df, plan, 8, F.col("user_key")).groupBy("_task").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 1500
    got = {r["key_value"]: (r["rows"], r["members"]) for r in per_key_results(df, tasks=8).collect()}
    assert got == {None: (4000, 4000), **{n: (80, 80) for n in range(50)}}


def test_per_key_results_of_nothing(spark):
    assert per_key_results(spark.createDataFrame([], "key_field string, key_value long, user_key string")).collect() == []


def test_flat_tables(spark):
    record = [
        {"task": "combo", "value": [{"task": "T1", "value": [None, {"tool": 0, "details": [None, {}, {"value": None}, 3]}]}, {"task": "T2", "value": 1}]},
        {"task": "S", "value": [{"choice": "A", "answers": {"N": "1", "B": []}}, {"choice": "B", "answers": {}}, 5]},
        {"task": "D", "value": {"choice": "C", "answers": {"N": "2"}}},
        {"value": [{"details": [{}]}]},
        "odd",
    ]
    twice = json.dumps(json.dumps(record))
    rows = [(1, json.dumps(record)), (1, json.dumps(record)), (2, twice), (3, None), (4, ""), (5, "nonsense"), (6, "[]"), (7, "3")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, annotations string, task string")
    out = flat_tables(df).collect()
    follow = {(r["id"], r["task"], r["item_pos"], r["child"]) for r in out if r["level"] == "follow_ups"}
    one = {("T1", 1, "1"), ("T1", 1, "2"), ("S", 0, "N"), ("S", 0, "B"), ("D", 0, "N")}
    assert follow == {(i, *x) for i in (1, 2) for x in one}
    labels = {(r["id"], r["dewey"]) for r in out}
    assert len(labels) == len(out)
    for r in out:
        assert r["parent"] is None or (r["id"], r["parent"]) in labels
        assert r["parent"] == (r["dewey"].rsplit(".", 1)[0] if "." in r["dewey"] else None)


def test_dewey_nodes_give_the_record_back(spark):
    record = {"a": [1, {"b": None, "c": "x"}, []], "d": {"e": True}}
    rows = dewey_nodes(spark.createDataFrame([(1, json.dumps(record), 0), (2, None, 0)], "key long, j string, id int"), "key", "j").collect()
    assert {r["dewey"] for r in rows} == {"0", "0.0", "0.1", "0.1.0", "0.1.1", "0.2", "1", "1.0"}
    assert {r["schema_path"] for r in rows} == {"$.a", "$.a[]", "$.a[].b", "$.a[].c", "$.d", "$.d.e"}
    for depth in (3000, 20_000):
        deep = "[" * depth + "]" * depth
        assert sum(1 for _ in walk(load(deep))) == depth - 1
    twice = json.dumps([{"a": 1}])
    for _ in range(9):
        twice = json.dumps(twice)
    assert dewey_nodes(spark.createDataFrame([(1, twice)], "key long, j string"), "key", "j").count() == 2


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_deep_json_is_read_like_other_json(value):
    assert parse_deep(json.dumps(value)) == value


@pytest.mark.parametrize("bad", ["[", "[1,]", '{"a"}', "[1 2]", "]", "{1:2}", "", '{"a":1,}', "[1]]", "[,1]", '{"a":}'])
def test_malformed_json_is_refused(bad):
    with pytest.raises(ValueError):
        parse_deep(bad)


def test_roots(spark):
    links = [(n, n - 1) for n in range(1, 50)] + [(100, 60)]
    got = {r["child"]: r["root"] for r in roots(spark.createDataFrame(links, "child long, parent long")).collect()}
    assert got == {**{n: 0 for n in range(1, 50)}, 100: 60}
    with pytest.raises(ValueError):
        roots(spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"))


def test_user_key_and_versions(spark):
    rows = [(" \tÑandú\xa0", "1"), ("", "2"), ("  ", None), (None, "3")]
    got = [r[0] for r in spark.createDataFrame(rows, "user_name string, user_ip string").select(user_key()).collect()]
    assert got == ["ñandú", "2", None, "3"]
    order = spark.createDataFrame([("1.10",), ("1.9",), ("10.2",)], "v string").orderBy(version_rank(F.col("v"))).collect()
    assert [r[0] for r in order] == ["1.9", "1.10", "10.2"]


def test_ballots_of_every_shape(spark):
    values = {"1": 1, "1.0": 1, '"2"': 2, '" 0 "': 0, "true": None, "null": None, "[1]": None, "7": None, "-1": None, "1.5": None, '"x"': None, '"NaN"': None, "1e0": 1}
    rows = [(n, json.dumps([{"task": "T0", "value": json.loads(v)}]) if v != "null" else '[{"task":"T0","value":null}]') for n, v in enumerate(values)]
    df = spark.createDataFrame([*rows, (99, None), (98, "bad"), (97, '[3,{"task":"T0","value":1}]')], "id int, a string")
    got = {r[0]: r[1] for r in df.select("id", task_ballot(F.col("a"), F.lit("T0"), F.lit(3))).collect()}
    assert [got[n] for n in range(len(values))] == list(values.values())
    assert got[99] is None and got[98] is None and got[97] == 1


def test_words_regardless_of_dress(spark):
    texts = ["Le porc-épic, <b>d’été</b> &amp; 3 œufs", "LE PORC ÉPIC dete 3 oeufs".lower(), None, "", "été"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words(F.col("t"))).collect()]
    assert got[0] == got[1] == ["le", "porc", "epic", "dete", "3", "oeufs"]
    assert got[2] is None and got[3] == [] and got[4] == ["ete"]


def test_written_lines(spark):
    a = json.dumps([{"task": "T1", "value": [None, [], {"text": "one"}, {"details": [None, {"value": "two"}, {}]}, 5]}, {"task": "T2", "value": "x"}])
    assert spark.createDataFrame([(a,)], "a string").select(written_lines(F.col("a"))).first()[0] == ["one", "two"]


def test_vote_count_examples(spark):
    single = [(1, [0]), (1, [0]), (1, [1]), (1, None)]
    many = [(2, [0, 1]), (2, [0]), (2, [])]
    df = spark.createDataFrame([(7, s, "T", c) for s, c in single + many], "workflow_id int, subject_id int, task string, choices array<int>")
    got = {(r["subject_id"], r["answer"]): (round(r["p"], 4), r["num_users"]) for r in classify.vote_count(df).collect()}
    assert got == {(1, 0): (0.6667, 4), (1, 1): (0.3333, 4), (2, 0): (0.6667, 3), (2, 1): (0.3333, 3)}


def test_most_likely_tool_takes_the_highest_of_equals(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, 1)], "c int, tool int")
    got = {r["c"]: (r["tool"], round(r["p_tool"], 3)) for r in classify.most_likely_tool(df, ["c"]).collect()}
    assert got == {1: (1, 0.667), 2: (1, 0.5)}


def test_scores(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 1), (1, 2)], "s int, bin int")
    assert scoring.accumulate(df, ["s"]).first()["mean"] == pytest.approx((-1 + 3 + 3) / 5)
    bins = spark.createDataFrame([([1, 1, 1, 0],), ([1, 0, 1, 1],), ([0, 0, 0, 0],), ([1, 1],)], "a array<int>").select(scoring.score_bin(F.col("a")))
    assert [r[0] for r in bins.collect()] == [0, 2, 1, None]


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.uniform(-50, 50, (120, 2))
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "s int, pid int, x double, y double")
    got = {(r["left_id"], r["right_id"]) for r in evaluate.near_pairs(df, df, ["s"], 9.0, same=True).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if np.hypot(*(pts[i] - pts[j])) <= 9}
    assert got == want


def test_overlapping_rectangles_match_brute_force(spark):
    rng = np.random.default_rng(4)
    r = [(1, i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.uniform(1, 400, (60, 4)))]
    df = spark.createDataFrame(r, "s int, pid int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((x["left_id"], x["right_id"]) for x in evaluate.overlapping_rectangles(df, ["s"]).collect())
    want = sorted((a[1], b[1]) for a in r for b in r if a[1] < b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert got == want


def test_upsert_and_last_write(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "C"), (3, "D")], "k int, v string")
    assert sorted(map(str, store.upsert(old, new, ["k"]).collect())) == sorted(map(str, [*new.collect(), old.first()]))
    rows = spark.createDataFrame([(1, None, 5), (1, None, 9), (2, 3, 1)], "s int, u int, id int")
    assert {(r["s"], r["u"], r["id"]) for r in last_write(rows, ["s", "u"]).collect()} == {(1, None, 9), (2, 3, 1)}
    assert one_per_id(spark.createDataFrame([(1, 2), (1, 2), (None, 3), (None, 3)], "id int, v int"), "v").count() == 3


def test_clusters_of_a_crowded_subject_are_whole(spark):
    """A subject cut into many chunks gives the same five birds, no volunteer twice in any."""
    rng = np.random.default_rng(5)
    spots = [(100, 100), (400, 120), (250, 600), (800, 300), (700, 800)]
    rows = [(1, 9, "T", "point", n * 10 + k, k, f"u{n}", 0, [float(x + rng.normal(0, 2)), float(y + rng.normal(0, 2))]) for n in range(300) for k, (x, y) in enumerate(spots)]
    df = spark.createDataFrame(rows, "workflow_id int, subject_id long, task string, shape string, id long, item int, volunteer string, tool int, params array<double>")
    out = markings.cluster_marks(df, chunk=200)
    assert out.count() == len(rows)
    large = markings.cluster_summary(out).where("marks > 100").collect()
    assert len(large) == 5 and all(r["marks"] == r["volunteers"] for r in large)


def test_consistency_weights_stay_in_range(spark):
    rows = [(i, u, (i % 3) if u < 4 else 0) for i in range(12) for u in range(5)]
    df = spark.createDataFrame(rows, "item int, user int, label int")
    got = {r["user"]: r["weight"] for r in reliability.consistency_weights(df).collect()}
    assert all(0 <= w <= 1 for w in got.values()) and got[4] < got[0]
    em = {r["item"]: r["label"] for r in reliability.hard_em(df, 3).collect()}
    assert em == {i: i % 3 for i in range(12)}


def test_line_consensus(spark):
    rows = [(1, 1, 0, f"u{n}", t) for n, t in enumerate(["the old barn", "the old barn", "the oldd barn", "teh old barn", "the old barn"])]
    df = spark.createDataFrame(rows, "workflow_id int, subject_id long, line int, volunteer string, text string")
    assert text.consensus_lines(df).first()["text"] == "the old barn"


def test_shapes(spark):
    marks = {"point": [{"x": 1, "y": 2}, {"x": -1, "y": 2}, {"x": None, "y": 2}], "line": [{"x1": 5, "y1": 1, "x2": 2, "y2": 3}], "rectangle": [{"x": 1, "y": 1, "width": 0, "height": 3}, {"x": 1, "y": 1, "width": 2, "height": 3}]}
    rows = [(s, json.dumps(m)) for s, ms in marks.items() for m in ms]
    df = spark.createDataFrame(rows, "s string, m string").select(ingest.shape_params(F.col("s"), F.from_json("m", ingest.MARK)).alias("p"))
    assert [r["p"] for r in df.collect()] == [[1, 2], None, None, [2, 3, 5, 1], None, [1, 1, 3, 4]]


def test_overlap_groups_match_brute_force(spark):
    rng = np.random.default_rng(9)
    boxes = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in rng.uniform(1, 300, (40, 4)) * [3, 3, 0.3, 0.3]]
    boxes += boxes[:5]
    df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], "s int, pid int, x1 double, y1 double, x2 double, y2 double")
    meets = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    edges = [(i, j) for i in range(len(boxes)) for j in range(i) if meets(boxes[i], boxes[j])]
    size = {i: len(c) for c in kernels.components(len(boxes), edges) for i in c}
    links = defaultdict(int)
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    got = {r["pid"]: (r["group_size"], r["links"]) for r in evaluate.overlap_groups(df, ["s"]).collect()}
    assert got == {i: (size[i], links[i]) for i in range(len(boxes))}
    assert evaluate.overlap_groups(df.limit(0), ["s"]).collect() == []


def test_marks_beyond_the_image(spark):
    rows = [(1, "rectangle", [1.0, 1.0, 50.0, 50.0]), (1, "rectangle", [1.0, 1.0, 150.0, 50.0]), (1, "point", [500.0, 500.0]), (2, "line", [1.0, 1.0, 150.0, 50.0])]
    sizes = spark.createDataFrame([(1, 100.0, 100.0), (2, None, None), (None, 1.0, 1.0)], "subject_id int, height double, width double")
    got = ingest.within_image(spark.createDataFrame(rows, "subject_id int, shape string, params array<double>"), sizes).collect()
    assert sorted((r["subject_id"], r["shape"], r["params"][-1]) for r in got) == [(1, "point", 500.0), (1, "rectangle", 50.0), (2, "line", 50.0)]


def test_detail_summary_and_outliers_of_clusters(spark):
    point = lambda i, u, t, x: (1, 9, "T", "point", 7, i, 0, u, t, [float(x), 0.0])
    members = spark.createDataFrame([point(n, f"u{n}", int(n > 0), 60 if n == 7 else 0) for n in range(8)], "workflow_id int, subject_id long, task string, shape string, cluster long, id long, item int, volunteer string, tool int, params array<double>")
    seen = spark.createDataFrame([(1, 9, "T", f"u{n}") for n in range(10)], "workflow_id int, subject_id long, task string, volunteer string")
    keys = ["workflow_id", "subject_id", "task", "shape", "cluster"]
    r = markings.detail(members, seen, keys).first()
    assert (r["tool"], r["p_tool"], r["p_true_positive"], r["num_viewers"], r["centre"]) == (1, 0.875, 0.8, 10, [0.0, 0.0])
    assert markings.summary(markings.detail(members, seen, keys), keys[:3]).first()["clusters"] == 1
    assert markings.outliers(members, keys, 4.0).first()["ratio"] == 8.0


def test_likeliest_follow_up_answer(spark):
    rows = [(1, 2, "Z", "Q", "b", 3), (1, 2, "Z", "Q", "a", 3), (1, 2, "Z", "Q", "c", 2)]
    df = spark.createDataFrame(rows, "workflow_id int, subject_id int, species string, question string, answer string, votes long")
    assert [(r["answer"], r["share"]) for r in survey.top_answer(df).collect()] == [("a", 0.375)]
