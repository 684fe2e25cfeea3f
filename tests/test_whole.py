"""Queries and operators do the whole job: nothing left out, cut off or rounded on the way."""

from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.kernels import cluster as kernels
from tallyfield.operators import evaluate, markings, reliability, text
from tallyfield.operators.pointers import components
from tallyfield.plans import reference, reports

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@tables
def test_point_queries_see_every_workflow(spark):
    by = {0: defaultdict(list), 1: defaultdict(list)}
    for r in reference.marks(spark, FOLDER).where("shape = 'point' AND tool IN (0, 1)").collect():
        by[r["tool"]][r["workflow_id"], r["subject_id"]].append((f"{r['id']}:{r['item']}", np.array(r["params"][:2])))
    far = lambda a, b: float(np.hypot(*(a[1] - b[1])))
    nearest = lambda a, others: min(((far(a, b), b[0]) for b in others), default=(np.inf, None))
    pairs, smooth = set(), {}
    for key, points in by[0].items():
        others = by[1][key]
        for a in points:
            d, b = nearest(a, others)
            if d <= 60 and nearest(next(o for o in others if o[0] == b), points)[1] == a[0]:
                pairs.add((*key, a[0], b))
            near = np.array([far(a, o) for o in points if o[0] != a[0] and far(a, o) <= 40])
            if len(near):
                w = np.exp(-near * near / 225)
                smooth[(*key, a[0])] = (w * near).sum() / w.sum()
    got = {(r["workflow_id"], r["subject_id"], r["left_id"], r["right_id"]) for r in reports.mutual_nearest_marks(spark, FOLDER).collect()}
    assert got == pairs
    rows = {(r["workflow_id"], r["subject_id"], r["pid"]): r["smooth"] for r in reports.neighbour_smoothing(spark, FOLDER).collect()}
    assert rows == pytest.approx(smooth) and 2102 in {k[0] for k in rows}


MARK = "workflow_id int, subject_id long, task string, shape string, id long, item int, volunteer string, tool int, params array<double>"


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(n, n + 1) for n in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))] + [(-5, -5), (7, 3), (3, 7)]
    nodes = sorted({n for e in edges for n in e})
    place = {n: i for i, n in enumerate(nodes)}
    want = {nodes[i]: nodes[c[0]] for c in kernels.components(len(nodes), [(place[a], place[b]) for a, b in edges]) for i in c}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("kernel", ["friends", "dbscan"])
def test_linked_clusters_of_a_crowded_subject_equal_one_pass(spark, kernel):
    """A long chain and scattered marks, cut into chunks or not, give the clusters of one pass over all marks."""
    rng = np.random.default_rng(7)
    points = [(15.0 * n, 50.0) for n in range(150)] + [(float(x), float(y)) for x, y in rng.uniform(100, 900, (250, 2))]
    rows = [(1, 9, "T", "point", n, 0, f"u{n % 90}", 0, list(p)) for n, p in enumerate(points)]
    out = markings.cluster_marks(spark.createDataFrame(rows, MARK), kernel, chunk=100)
    got = defaultdict(list)
    for r in out.collect():
        got[r["cluster"]].append(r["id"])
    volunteers = [r[6] for r in rows]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, markings.KERNELS[kernel](np.array(points), volunteers)))


def test_clustering_ends_when_nothing_can_be_joined(spark):
    """Two volunteers with more marks than a chunk: rounds by hash join nothing, the last is one piece."""
    rows = [(1, 9, "T", "point", n * 2 + k, 0, f"u{k}", 0, [100.0 * n, 0.5 * k]) for n in range(30) for k in range(2)]
    out = markings.cluster_marks(spark.createDataFrame(rows, MARK), chunk=20)
    groups = defaultdict(list)
    for r in out.collect():
        groups[r["cluster"]].append(r["id"] // 2)
    assert sorted(map(tuple, groups.values())) == [(n, n) for n in range(30)]


def test_marks_left_out_by_split_clicks_are_in_no_cluster(spark):
    """One volunteer clicks twice on each of two birds: the second clicks are left out, whether the subject is cut or not."""
    rng = np.random.default_rng(9)
    spots = [(100.0, 100.0), (600.0, 500.0)]
    rows = [(1, 9, "T", "point", n * 10 + k, 0, f"u{n}", 0, (rng.normal(0, 1, 2) + spots[k]).tolist()) for n in range(40) for k in range(2)]
    rows += [(1, 9, "T", "point", n * 10 + k + 5, 1, f"u{n}", 0, (rng.normal(0, 1, 2) + spots[k] + 3).tolist()) for n in range(20) for k in range(2)]
    points, users = np.array([r[8] for r in rows]), [r[6] for r in rows]
    kept = sum(map(len, markings.KERNELS["split_clicks"](points, users)))
    assert kept < len(rows)
    for chunk in (4000, 50):
        out = markings.cluster_marks(spark.createDataFrame(rows, MARK), "split_clicks", chunk=chunk).collect()
        assert all(r["cluster"] != 0 for r in out) and 0 < len(out) < len(rows)
        assert len({(r["cluster"], r["volunteer"]) for r in out}) == len(out)


def test_split_clicks_of_a_crowded_subject_equal_one_pass(spark):
    """Groups above ``chunk`` marks, one of them without repeated volunteers, have the clusters of one pass over all marks."""
    rng = np.random.default_rng(10)
    points = [p.tolist() for p in rng.uniform(0, 500, (300, 2))]
    rows = [(1, s, "T", "point", s * 1000 + n, 0, f"u{n % 90 if s == 9 else n}", 0, p) for s in (9, 10) for n, p in enumerate(points)]
    out = markings.cluster_marks(spark.createDataFrame(rows, MARK), "split_clicks", chunk=50)
    got = defaultdict(list)
    for r in out.collect():
        got[r["subject_id"], r["cluster"]].append(r["id"] - r["subject_id"] * 1000)
    nodes = {r["id"]: r["n"] for r in spark.createDataFrame(rows, MARK).select("id", F.xxhash64("id", "item").alias("n")).collect()}
    for s in (9, 10):
        order = sorted(range(300), key=lambda n: nodes[s * 1000 + n])
        want = markings.KERNELS["split_clicks"](np.array([points[n] for n in order]), [f"u{n % 90 if s == 9 else n}" for n in order])
        assert sorted(sorted(v) for k, v in got.items() if k[0] == s) == sorted(sorted(order[i] for i in c) for c in want)


def test_linkage_in_tiles_equals_one_pass(spark):
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(0, 5, (500, 2)), rng.uniform(0, 1000, (100, 2))])
    users = rng.integers(0, 300, 600).tolist()
    want = kernels.ward(kernels.pairwise(points))
    got = kernels.ward_rows(points, markings.by_tasks(spark), tile=24, whole=60)
    assert sorted(m[2] for m in got) == pytest.approx([m[2] for m in want])
    assert kernels.cut_by_user(got, users) == kernels.cut_by_user(want, users)


def test_connected_lines_run_through_bands(spark):
    """Upright strokes, each lying along the next: bands see parts of the chain only, whichever mark is the least."""
    rows = [(1, 9, n, 0, "text", [50.0, 50.0, 15.0 * n, 15.0 * n + 95]) for n in range(60)] + [(1, 9, 99, 0, "text", [500.0, 900.0, 20.0, 20.0])]
    df = spark.createDataFrame(rows, "workflow_id int, subject_id long, id long, item int, shape string, params array<double>")
    got = text.connected_lines(df).collect()
    assert sorted(r["id"] for r in got) == list(range(60)) and len({r["component"] for r in got}) == 1


def test_every_volunteer_of_a_line_counts(spark):
    rows = [(1, 1, 0, f"u{n}", "the old barn" if n < 900 else "the odd barn") for n in range(1000)]
    df = spark.createDataFrame(rows, "workflow_id int, subject_id long, line int, volunteer string, text string")
    got = text.consensus_lines(df).first()
    assert (got["text"], got["agreement"], got["texts"], got["volunteers"]) == ("the old barn", 1.0, 2, 1000)


def test_curves_keep_every_score(spark):
    rng = np.random.default_rng(8)
    score, truth = rng.integers(0, 5000, 4000) / 5000, rng.integers(0, 2, 4000)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, truth, strict=True)], "score double, truth int")
    want = {float(s): (int(truth[score >= s].sum()), int((1 - truth)[score >= s].sum())) for s in set(score)}
    got = evaluate.roc(df).collect()
    assert len(got) == len(want) and {r["score"]: (r["cum_t"], r["cum_f"]) for r in got} == want
    samples = df.select(F.col("score").alias("value"), F.col("truth").alias("side"))
    ks = max(abs((score[truth == 0] <= s).mean() - (score[truth == 1] <= s).mean()) for s in set(score))
    assert evaluate.ks_distance(samples).first()["ks"] == pytest.approx(ks, abs=1e-9)


def test_hard_em_goes_on_until_no_label_changes(spark, monkeypatch):
    votes = spark.createDataFrame([(i, u, (i % 3) if u < 4 else 0) for i in range(12) for u in range(5)], "item int, user int, label int")
    with pytest.warns(RuntimeWarning, match="after 1 rounds"):
        reliability.hard_em(votes, 3, rounds=1)
    asked = {}
    monkeypatch.setattr(reference, "votes", lambda *_: votes)
    monkeypatch.setattr(reliability, "hard_em", lambda v, labels, **more: asked.update(more))
    reference.hard_em(spark, FOLDER)
    assert asked.get("rounds", 50) >= 50
