import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.kernels import align, cluster, raster


def test_cut_by_user_example():
    merges = [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (5, 6, 3.0, 4), (4, 7, 4.0, 5)]
    assert cluster.cut_by_user(merges, ["a", "b", "c", "c", "e"]) == [[0, 1], [2], [3], [4]]


def test_distinct_users_are_one_cluster():
    assert cluster.agglomerate(np.array([[0, 0], [500, 0], [0, 900]]), [1, 2, 3]) == [[0, 1, 2]]


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 25), st.integers(0, 10_000))
def test_ward_and_clusters(n, seed):
    rng = np.random.default_rng(seed)
    points, users = rng.uniform(0, 100, (n, 2)), rng.integers(0, 4, n).tolist()
    merges = cluster.ward(points)
    heights = [m[2] for m in merges]
    assert len(merges) == n - 1 and heights == sorted(heights) and merges[-1][3] == n
    parts = cluster.agglomerate(points, users)
    assert sorted(i for p in parts for i in p) == list(range(n))
    assert all(len({users[i] for i in p}) == len(p) for p in parts)
    for other in (cluster.divisive_dbscan(points, users), cluster.divisive_kmeans(points, users)):
        assert sorted(i for p in other for i in p) == list(range(n))
        assert all(len({users[i] for i in p}) == len(p) for p in other)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 80), st.integers(0, 10_000))
def test_linkage_in_tiles(n, seed):
    rng = np.random.default_rng(seed)
    points, users = rng.uniform(0, 100, (n, 2)), rng.integers(0, n, n).tolist()
    for p in (points, np.concatenate([points, points[: n // 5]])):  # equal points may merge in another order
        want, got = cluster.ward(cluster.pairwise(p)), cluster.ward_rows(p, tile=8, whole=12, axes=3)
        assert np.allclose([m[2] for m in want], sorted(m[2] for m in got), atol=1e-3)
        assert [m[3] for m in got][-1:] == [m[3] for m in want][-1:]
        if p is points:
            assert cluster.cut_by_user(got, users) == cluster.cut_by_user(want, users)


def test_split_clicks_are_merged_until_none_is_left():
    """120 spots with two clusters each: all are merged; a shared second mark is left out."""
    points = np.array([[100.0 * s + x, 0] for s in range(120) for x in (0, 1, 6, 7)])
    users = [u for s in range(120) for u in ("a", "b", "c", "a" if s == 0 else "d")]
    clusters = [[4 * s + k, 4 * s + k + 1] for s in range(120) for k in (0, 2)]
    assert cluster.merge_split_clicks(clusters, points, users) == [[0, 1, 2]] + [[4 * s + k for k in range(4)] for s in range(1, 120)]


def test_dbscan_friends_and_cliques():
    p = np.array([[0, 0], [1, 0], [2, 0], [50, 50], [51, 50], [99, 0]], float)
    assert cluster.dbscan(p, 1.5, 2).tolist() == [0, 0, 0, 1, 1, -1]
    assert cluster.friends(p, 1.5) == [[0, 1, 2], [3, 4], [5]]
    assert cluster.cliques(4, [(0, 1), (1, 2), (0, 2), (2, 3)]) == [[0, 1, 2], [2, 3]]
    assert len(cluster.convex_hull(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2]]))) == 4


def test_polygons():
    square = np.array([[2, 2], [8, 2], [8, 8], [2, 8]], float)
    assert raster.fill(square, 20, 20).sum() == 36 == raster.shoelace(square)
    found = raster.consensus([square, square + 1, square], ["a", "b", "c"], [0, 0, 1], 20, 20)
    assert len(found) >= 1 and abs(sum(f[1] for f in found) - 36 / 400) < 0.05
    mask = np.zeros((4, 4), bool)
    mask[1:3, 1:3] = True
    assert raster.outline(mask) == [(1, 1), (3, 1), (3, 3), (1, 3)]
    mask[3, 3] = True
    assert raster.regions(mask).max() == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc ", min_size=0, max_size=12), min_size=1, max_size=5))
def test_alignment_gives_texts_back(texts):
    rows = align.align(texts)
    assert [r.replace(align.GAP, "") for r in rows] == texts
    assert len({len(r) for r in rows}) == 1
    line, agreement = align.vote(rows)
    assert len(line) == len(rows[0]) and 0 <= agreement <= 1


def test_votes_on_characters():
    assert align.vote(["a", "a", "b"])[0] == "a"
    assert align.vote(["a", "A"])[0] == "A"
    assert align.vote(["a", "b"])[0] == align.DISAGREE
    assert align.mark_outside(f"{align.GAP}ello") == f"{align.OUTSIDE}ello"
    assert align.levenshtein("kitten", "sitting") == 3
    assert align.common_substring("the old barn", "an old bar") == " old bar"
    assert align.common_subsequence(["abcd", "acbd"]) in ("abd", "acd")
