"""The operators on training data leave nothing out."""

from collections import Counter

import numpy as np
import pytest

from tallyfield.llm import clusters, consensus
from tallyfield.session import durable

BALLOT = "workflow_id int, subject_id long, task string, n_answers int, user_key string, answer int"


def crowd(seed, subjects, spam, honest):
    rng = np.random.default_rng(seed)
    truth, rows = rng.integers(0, 3, subjects), []
    for s in range(subjects):
        rows += [(1, s, "T0", 3, f"h{u}", int(truth[s]) if rng.random() < 0.6 else int(rng.integers(3))) for u in rng.choice(honest, 5, replace=False)]
        rows += [(1, s, "T0", 3, f"s{u}", 2) for u in rng.choice(spam, 3, replace=False)]
    return rows, truth


def test_every_subject_with_a_ballot_gets_an_answer(spark):
    rows = [(1, 1, "T", 2, f"u{n}", 1) for n in range(4)] + [(1, 2, "T", 2, f"u{n}", n % 2) for n in range(6)]
    rows += [(1, 3, "T", 2, "lone", 0), (1, 4, "T", 2, "u1", 1), (2, 5, "S", 3, "u1", 2), (1, 6, "T", 2, "u2", 1), (1, 6, "T", 2, "u3", 1)]
    ballots = spark.createDataFrame(rows, BALLOT)
    got = {(r["workflow_id"], r["subject_id"]): r for r in consensus.consensus(ballots, consensus.Settings(min_ballots=1)).subjects.collect()}
    assert {k: r["ballots"] for k, r in got.items()} == {(1, 1): 4, (1, 2): 6, (1, 3): 1, (1, 4): 1, (2, 5): 1, (1, 6): 2}
    assert got[1, 1]["answer"] == 1 and got[1, 6]["answer"] == 1 and got[1, 6]["agreement"] is not None
    assert all(got[k]["agreement"] is None and got[k]["share"] == pytest.approx(1) for k in [(1, 3), (1, 4), (2, 5)])
    assert [r["subject_id"] for r in consensus.consensus(ballots).subjects.collect()] == [2]


def test_rounds_go_on_until_no_answer_changes(spark):
    rows, _ = crowd(seed=2, subjects=400, spam=8, honest=40)
    ballots = spark.createDataFrame(rows, BALLOT)
    out = consensus.consensus(ballots)
    assert out.changed == 0 and out.rounds < consensus.Settings().max_rounds
    with pytest.warns(RuntimeWarning, match="still change after 1 rounds"):
        assert consensus.consensus(ballots, consensus.Settings(max_rounds=1)).changed > 0


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_round_sends_weights_and_truths_without_keys(spark):
    """Four bytes for each possible truth and four back, besides what doesn't depend on the rounds."""
    rows, _ = crowd(seed=5, subjects=1500, spam=30, honest=300)
    ballots = spark.createDataFrame(rows, BALLOT)
    cost = {}
    for rounds in (1, 4):
        before = shuffled(spark)
        with pytest.warns(RuntimeWarning, match="still change"):
            consensus.consensus(ballots, consensus.Settings(max_rounds=rounds)).subjects.collect()
        cost[rounds] = shuffled(spark) - before
    assert 0 < (cost[4] - cost[1]) / 3 < 24 * len(rows)


def groups_by_brute_force(texts, least_share=0.25, least_shared=4.0):
    """Root of each record: every record is held against all denser ones. Without stock phrases; ids and texts are unique."""
    words = {i: t.split() for i, t in texts.items()}
    has = {i: set(zip(w, w[1:], strict=False)) for i, w in words.items()}
    df = Counter(f for fs in has.values() for f in fs)
    rank = {i: (sum(df[f] for f in fs if df[f] > 1), -i) for i, fs in has.items()}
    lead = {f: max((i for i in has if f in has[i]), key=rank.get) for f in df}
    parent = {}
    for i, fs in has.items():
        need = max(least_share * len(fs), least_shared)
        share = {j: len(fs & has[j]) for j in has if rank[j] > rank[i] and len(fs & has[j]) >= need}
        if share:
            most = max(share.values())
            led = Counter(lead[f] for f in fs if lead[f] != i)
            first = max(led, key=lambda j: (led[j], -j), default=None)
            parent[i] = first if share.get(first) == most else min(j for j in share if share[j] == most)
    def root(i):
        return root(parent[i]) if i in parent else i
    return {i: root(i) for i in has}


def members_by_root(root):
    sizes = Counter(root.values())
    least = {}
    for i, r in sorted(root.items()):
        least.setdefault(r, i)
    return {i: least[r] for i, r in root.items() if sizes[r] > 1}


@pytest.mark.parametrize("sought", [2_000_000, 500])
def test_every_record_follows_the_denser_one_that_it_shares_most_with(spark, sought):
    """Pages of common phrases: many records lead a block, so a record's best is often neither a leader nor a peak."""
    rng = np.random.default_rng(11)
    phrases = [[f"w{n}" for n in rng.integers(0, 60, 4)] for _ in range(40)]
    texts = {}
    for i in range(160):
        words = [w for k in rng.choice(40, 6, replace=False) for w in phrases[k]]
        texts[i] = " ".join(w if rng.random() < 0.93 else f"x{i}" for w in words)
    out = clusters.clusters(spark.createDataFrame(list(texts.items()), "id long, text string"), clusters.Settings(stock_least=1000, sought=sought))
    want = members_by_root(groups_by_brute_force(texts))
    assert len(set(want.values())) > 1 and {r["id"]: r["cluster_id"] for r in out.members.collect()} == want


def test_a_record_like_a_linked_one_joins_its_group(spark):
    """Record 3 shares enough with 2 alone. 2 is linked to 1, and each pair that 3 and 2 share is led by another, denser record."""
    run = lambda name, n: [f"{name}{k}" for k in range(n)]
    shared, page = run("s", 7), run("p", 40)
    texts = {1: page, 2: [*page[:20], *shared], 3: [*shared, *run("q", 8)], 4: [*page, "more"]}
    for k in range(6):  # a denser record for each pair
        other = run(f"o{k}", 40)
        texts[10 + 2 * k], texts[11 + 2 * k] = [*other, *shared[k : k + 2]], other
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    got = {r["id"]: r["cluster_id"] for r in clusters.clusters(spark.createDataFrame(rows, "id long, text string")).members.collect()}
    assert got[1] == got[2] == got[3] == got[4] == 1 and len(set(got.values())) == 7


def test_word_pairs_are_numbered_without_gaps(spark):
    rows = [(n * 7919 % 100_003, n % 5 + 2) for n in range(999)]
    shared = durable(spark.createDataFrame(rows, "f long, df long").repartition(7, "f").where("f % 3 > 0 OR df > 4"))
    got = clusters._numbered(shared).collect()
    assert sorted(r["number"] for r in got) == list(range(shared.count())) and {(r["f"], r["df"]) for r in got} <= set(rows)


def test_word_pairs_cross_shuffles_as_numbers(spark):
    """Bytes shuffled for each word pair of all records."""
    rng = np.random.default_rng(12)
    pages = [[f"w{n}" for n in rng.integers(0, 4000, 40)] for _ in range(500)]
    rows = [(i, " ".join(w if rng.random() < 0.95 else f"x{i}" for w in pages[i % 500])) for i in range(3000)]
    before = shuffled(spark)
    out = clusters.clusters(spark.createDataFrame(rows, "id long, text string"), clusters.Settings(stock_least=5000)).members.collect()
    assert len(out) == 3000 and len({r["cluster_id"] for r in out}) == 500
    assert (shuffled(spark) - before) / (3000 * 39) < 65
