"""Operators on training data: brute force, exact round trips and planted cases on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import clusters, consensus, leakage, mixture, tokens, truncation
from tallyfield.llm.queries import QUERIES

BALLOT = "workflow_id int, subject_id long, task string, n_answers int, user_key string, answer int"


def crowd(seed=1, subjects=150, spam=6, honest=24):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 3, subjects)
    rows = []
    for s in range(subjects):
        for u in rng.choice(honest, 7, replace=False):
            rows.append((1, s, "T0", 3, f"h{u}", int(truth[s]) if rng.random() < 0.75 else int(rng.integers(3))))
        for u in rng.choice(spam, 4, replace=False):
            rows.append((1, s, "T0", 3, f"s{u}", 2))
    return rows, truth


def test_consensus_sees_through_a_ring(spark):
    rows, truth = crowd()
    out = consensus.consensus(spark.createDataFrame(rows, BALLOT))
    got = {r["subject_id"]: r["answer"] for r in out.subjects.collect()}
    by = defaultdict(list)
    for _, s, _, _, _, a in rows:
        by[s].append(a)
    plain = np.mean([min(Counter(by[s]), key=lambda a: (-Counter(by[s])[a], a)) == truth[s] for s in by])
    ours = np.mean([got[s] == truth[s] for s in range(len(truth))])
    assert ours > 0.93 and ours > plain
    accuracy = {r["user_key"]: r["accuracy"] for r in out.volunteers.collect()}
    assert max(accuracy[f"s{u}"] for u in range(6)) < min(accuracy[f"h{u}"] for u in range(24))


def test_consensus_edges(spark):
    nothing = spark.createDataFrame([], BALLOT)
    out = consensus.consensus(nothing)
    assert out.subjects.collect() == [] and out.volunteers.collect() == []
    few = [(1, 1, "T", 2, f"u{n}", 1) for n in range(4)] + [(1, 2, "T", 2, f"u{n}", n % 2) for n in range(6)] + [(1, 3, "T", 2, "lone", 0), (1, 4, "T", 2, None, 0)]
    out = consensus.consensus(spark.createDataFrame([(*r, "x") for r in few], BALLOT + ", label string"))
    assert [r["subject_id"] for r in out.subjects.collect()] == [2]
    assert {r["user_key"]: r["accuracy"] for r in out.volunteers.collect()}["lone"] == pytest.approx(0.7)


def test_agreement_is_one_when_all_agree(spark):
    rows = [(1, s, "T", 2, f"u{n}", s % 2) for s in range(6) for n in range(5)]
    assert all(r["agreement"] == pytest.approx(1) for r in consensus.consensus(spark.createDataFrame(rows, BALLOT)).subjects.collect())


def pages(seed=3, wordings=12, copies=8, hot=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    common = [word() for _ in range(40)]
    heading = "list of hands present at the evening muster"
    rows, truth, n = [], {}, 0
    for w in range(wordings):
        lines = [" ".join(word() if rnd.random() < 0.4 else rnd.choice(common) for _ in range(7)) for _ in range(4)]
        for _ in range(hot if w == 0 else copies):
            mine = [heading, *lines]
            if rnd.random() < 0.3:
                del mine[rnd.randrange(1, 5)]
            if rnd.random() < 0.3:
                rnd.shuffle(mine)
            text = list("\n".join(mine))
            for _ in range(rnd.randrange(4)):
                i = rnd.randrange(len(text))
                if text[i].isalpha():
                    text[i] = rnd.choice("aeiou")
            n += 1
            rows.append((n, "".join(text)))
            truth[n] = w
    return rows, truth, heading


def test_clusters_are_the_wordings(spark):
    rows, truth, heading = pages()
    extra = [(9001, heading), (9002, heading), (9003, None), (9004, ""), (9005, "[unclear][/unclear]"), (9006, "alone")]
    df = spark.createDataFrame([(*r, 0) for r in [*rows, *extra, rows[0]]], "id long, text string, c int")
    out = clusters.clusters(df)
    got = {r["id"]: r["cluster_id"] for r in out.members.collect()}
    assert set(got) == set(truth)
    pairs = {(got[i], w) for i, w in truth.items()}
    assert len(pairs) == len(set(truth.values())) == len({c for c, _ in pairs})
    assert all(c == min(i for i in got if got[i] == c) for c in set(got.values()))
    sizes = {r["cluster_id"]: r for r in out.summary.collect()}
    assert sum(r["records"] for r in sizes.values()) == len(got)
    assert all(got[i] == c for c, r in sizes.items() for i in r["typical"])


def test_clusters_of_nothing(spark):
    out = clusters.clusters(spark.createDataFrame([], "id long, text string"))
    assert out.members.collect() == [] and out.summary.collect() == []


def brute_leaks(documents, items, settings=leakage.Settings()):
    found = {}
    for d, w in documents.items():
        for i, v in items.items():
            for o in range(-len(v), len(w)):
                places = [q for q in range(len(v)) if 0 <= q + o < len(w)]
                same = {q for q in places if v[q] == w[q + o]}
                for a in same:
                    changed = []
                    for q in range(a, len(v)):
                        if q not in same:
                            if not 0 <= q + o < len(w) or q - 1 in changed:
                                break
                            changed.append(q)
                            if len([c for c in changed if c > q - settings.passage]) > settings.changed:
                                break
                        elif q - a + 1 >= settings.passage:
                            found[d, i] = max(found.get((d, i), 0), q - a + 1)
    return found


def test_leaks_match_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{n}" for n in range(60)]
    items = {i: [rnd.choice(vocabulary) for _ in range(rnd.randint(15, 60))] for i in range(8)}
    documents = {}
    for d in range(40):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        if d % 2:
            v = items[rnd.randrange(8)]
            a = rnd.randrange(len(v))
            part = v[a : a + rnd.randint(10, 40)]
            for _ in range(rnd.randint(0, 5)):
                part[rnd.randrange(len(part))] = "other"
            w[len(w) // 2 : len(w) // 2] = part
        documents[d] = w
    ddf = spark.createDataFrame([(d, " ".join(w), 1) for d, w in documents.items()], "doc_id long, text string, item_id int")
    idf = spark.createDataFrame([(i, " ".join(w), "s") for i, w in items.items()], "item_id long, text string, d string")
    got = {(r["doc_id"], r["item_id"]): r["passage"] for r in leakage.leaks(ddf, idf).collect()}
    assert got == brute_leaks(documents, items)


def test_leaks_look_through_dress_and_instructions(spark):
    body = [f"word{chr(97 + n % 26)}{n}x" for n in range(30)]
    stock = "Answer with care."
    items = [(1, f"{stock}\n{' '.join(body)}"), (2, f"{stock} {' '.join(reversed(body))}"), (3, f"{stock} nothing else"), (4, None), (5, "")]
    dressed = "<p>" + " , ".join(w.upper() for w in body[:24]) + "</p>"
    documents = [(1, dressed), (2, stock * 9), (3, " ".join(body[:19])), (4, None), (5, ""), (1, dressed)]
    ddf, idf = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leakage.leaks(ddf, idf).collect()] == [(1, 1)]
    assert leakage.leaks(ddf.limit(0), idf).collect() == [] and leakage.leaks(ddf, idf.limit(0)).collect() == []
    with pytest.raises(ValueError):
        leakage.leaks(ddf, idf, leakage.Settings(changed=6))


@pytest.mark.parametrize("budget", [None, 60_000, 10**9])
def test_quotas(budget):
    available = {"a": 50_000, "b": 30_000, "c": 1_000, "x": 9_000}
    targets = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.1, 3), "gone": (0.1, 5)}
    q = mixture.quotas(available, targets, budget)
    assert set(q) == {"a", "b", "c"} and all(q[s] <= available[s] * targets[s][1] for s in q)
    if budget is None:
        assert q["c"] == 3_000 and q["a"] == pytest.approx(15_000, abs=1) and q["b"] == pytest.approx(9_000, abs=1)
    if budget == 60_000:
        assert sum(q.values()) == pytest.approx(60_000, abs=3) and q["c"] == 3_000
    if budget == 10**9:
        assert q == {"a": 100_000, "b": 30_000, "c": 3_000}


def test_splitting_tree_deals_every_use_once():
    counts = np.array([500, 0, 33, 7])
    table = mixture.split(counts, 7, np.random.default_rng(1))
    assert table.shape == (7, 4) and (table.sum(0) == counts).all() and np.ptp(table.sum(1)) <= 7


def test_plan_of_a_very_large_corpus():
    """10**13 tokens: shards follow the blocks, every use is dealt once, no shard is left empty."""
    s = mixture.Settings()
    available = {"a": 6 * 10**12, "b": 3 * 10**12, "c": 10**12}
    quota = mixture.quotas(available, {"a": (0.5, 1), "b": (0.25, 1), "c": (0.25, 3)}, None)
    per_block = 2 * sum(available.values()) // s.max_blocks
    blocks = [{"source": n, "block": k, "t": per_block} for n, t in available.items() for k in range(t // per_block)]
    plan = mixture._plan(blocks, available, quota, per_block, s)
    used = Counter(r[3] for r in plan)
    assert len({r[:3] for r in plan}) == len(plan) and 500 < len(used) <= len(plan) / s.shard_blocks + 1
    assert set(used) == set(range(len(used))) and min(used.values()) >= s.shard_blocks // 2
    assert mixture.split(np.array([900_000, 0, 77]), 5000, np.random.default_rng(2)).sum(0).tolist() == [900_000, 0, 77]


def test_mixture_meets_its_targets(spark):
    rnd = random.Random(5)
    rows = [(n, rnd.choice(["A b", "a_b", " a_B "]) if n % 3 else ("c" if n % 2 else "d"), " ".join(rnd.choice(["tide", "log", "owl"]) for _ in range(rnd.randint(5, 60)))) for n in range(900)]
    rows += [(2000, None, "x y"), (2001, "a_b", None), (2002, "a_b", ""), (None, "a_b", "z"), rows[5]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("a_b", 0.3, 1), ("c", 0.5, 2), ("e", 0.2, 3), ("d", 0.0, 9)], "source string, target_share double, max_repeats int")
    out = mixture.mixture(df, targets, mixture.Settings(block_tokens=500, shard_tokens=2_000, shard_blocks=2))
    docs, shares = out.documents.toPandas(), {r["source"]: r for r in out.shares.collect()}
    assert docs.groupby(["doc_id", "use"]).size().max() == 1
    assert docs.groupby("doc_id").size().max() <= 2
    assert shares["c"]["actual_share"] == pytest.approx(0.5 / 0.8, abs=0.02) and shares["a_b"]["actual_share"] == pytest.approx(0.3 / 0.8, abs=0.02)
    assert shares["e"]["tokens"] == 0 and not shares["e"]["met"] and shares["(none)"]["target_share"] is None
    assert docs["shard"].nunique() > 1
    for _, g in docs.groupby("shard"):
        assert sorted(g["position"]) == list(range(len(g)))
    again = mixture.mixture(df, targets, mixture.Settings(block_tokens=500, shard_tokens=2_000, shard_blocks=2)).documents.toPandas()
    assert sorted(map(tuple, docs.values)) == sorted(map(tuple, again.values))
    assert mixture.mixture(df.limit(0), targets).documents.collect() == []


def test_long_texts_are_counted_in_pieces():
    encode = tokens.encoding(f"{tokens.FOLDER}/{tokens.RANKS}").encode_ordinary
    text = "The tide rose. " * 20_000
    assert tokens.count(encode, text) == len(encode(text)) and tokens.count(encode, "") == 0
    assert tokens.count(encode, "<|endoftext|>") > 1 and tokens.count(encode, "\ud800") > 0


def corpus(n=1500, seed=9):
    rnd = random.Random(seed)
    subjects = ["the crew", "our team", "a few markers", "the night watch", "my neighbour"]
    verbs = ["counted", "described", "marked", "photographed", "checked"]
    objects = ["the heron", "two crabs", "a pale sponge", "the old ledger", "every frame"]
    ends = ["at low tide", "by the dry riverbed", "after the flood", "in the first batch", "near the waterhole"]
    sentence = lambda: f"{rnd.choice(subjects)} {rnd.choice(verbs)} {rnd.choice(objects)} {rnd.choice(ends)}".capitalize()
    rows, cut = [], set()
    for d in range(n):
        text = ". ".join(sentence() for _ in range(rnd.randint(4, 12))) + "."
        kind = d % 10
        if kind == 0:
            text = text[: max(60, len(text) - rnd.randint(3, 40))]
            while text[-1] in ". " or text.endswith(tuple(e.split()[-1] for e in ends)):
                text = text[:-1]
            cut.add(d)
        elif kind == 1:
            text = text[:-1]
        elif kind == 2:
            text = text[:-1] + "..."
        elif kind == 3:
            text += rnd.choice([" #heron", "\n— robin7", "\nCamp Ulmar", " :)"])
        rows.append((d, "Log book" if d % 3 else "log_book", text))
    return rows, cut


def test_truncated_texts_are_told_from_finished_ones(spark):
    rows, cut = corpus()
    extra = [(9001, "log_book", None), (9002, None, ""), (9003, None, "   "), (None, "log_book", "The crew coun")]
    out = truncation.truncation(spark.createDataFrame([(*r, 1) for r in [*rows, *extra]], "doc_id long, source string, text string, rule int"))
    got = {r["doc_id"] for r in out.documents.collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.02 * len(rows)
    share = {r["source"]: r for r in out.sources.collect()}
    assert share["log_book"]["documents"] == len(rows) and share["log_book"]["truncated"] == len(got)


def test_a_storage_limit_in_bytes_is_found(spark):
    rows, _ = corpus(1200, 4)
    long = [(5000 + n, "wire", ("é " + " ".join(t for _, _, t in rows[n : n + 9])).encode()[:700].decode(errors="ignore")) for n in range(40)]
    out = truncation.truncation(spark.createDataFrame([*rows, *long], "doc_id long, source string, text string"))
    limits = {(r["source"], r["size_limit"]) for r in out.limits.collect()}
    assert ("wire", 700) in limits


def test_truncation_of_nothing_and_of_one_endless_word(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert truncation.truncation(empty).documents.collect() == []
    one = spark.createDataFrame([(1, "a", "x" * 200_000), (2, "a", "Done.")], "doc_id long, source string, text string")
    assert truncation.truncation(one).sources.first()["documents"] == 2


def test_lengths():
    assert truncation.lengths("é<&\n😀") == [5, 9, 6, 12, 6, 6, 10]


def test_text_helpers(spark):
    df = spark.createDataFrame([("Twenty two & 3 and nine",)], "t string").select(clusters.plain_words(F.col("t")))
    assert df.first()[0] == ["20", "2", "3", "9"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    assert len(QUERIES[name](spark, "/root/testdata/sf0.001").collect()) > 0 or name == "p8_limits"


def test_agreement_by_hand(spark):
    """Pairs agree in 1 of 3 and 1 of 1 cases; of the paired ballots 0 0 1 | 1 1, ordered pairs agree in 8 of 20."""
    rows = [(1, 1, "T", 2, "a", 0), (1, 1, "T", 2, "b", 0), (1, 1, "T", 2, "c", 1), (1, 2, "T", 2, "a", 1), (1, 2, "T", 2, "b", 1), (1, 3, "T", 2, "d", 0)]
    got = {r["subject_id"]: r["agreement"] for r in consensus.consensus(spark.createDataFrame(rows, BALLOT), consensus.Settings(min_ballots=1)).subjects.collect()}
    chance = 8 / 20
    assert got[1] == pytest.approx((1 / 3 - chance) / (1 - chance)) and got[2] == pytest.approx(1) and got[3] is None


def test_weights_from_accuracy_alone(spark):
    rows, truth = crowd(3)
    out = consensus.consensus(spark.createDataFrame(rows, BALLOT), consensus.Settings(by_truth=False))
    assert np.mean([r["answer"] == truth[r["subject_id"]] for r in out.subjects.collect()]) > 0.8


def test_a_crowded_subject_and_a_busy_volunteer_change_nothing(spark):
    """Half of all ballots on one subject, and one volunteer on all: as in a plain run of the same rounds."""
    rows, _ = crowd(4, subjects=60)
    rows += [(1, 1000, "T0", 3, f"x{n}", n % 2) for n in range(600)] + [(1, s, "T0", 3, "busy", 1) for s in range(60)]
    df = spark.createDataFrame(rows, BALLOT)
    one = {r["subject_id"]: (r["answer"], r["ballots"]) for r in consensus.consensus(df.coalesce(1)).subjects.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        other = {r["subject_id"]: (r["answer"], r["ballots"]) for r in consensus.consensus(df).subjects.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == other and one[1000][1] == 600
