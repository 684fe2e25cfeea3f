"""One answer for each subject from volunteers who disagree.

Method: iteratively reweighted voting. Each round (1) sums the weighted votes of every subject, (2) compares each
ballot with the consensus of the *other* ballots on its subject, (3) turns each volunteer's smoothed leave-one-out
accuracy and answers into new weights, until no consensus changes or the rounds come back to where they were.

The weight of a ballot is not one number but one for each possible truth: the log of the chance that this
volunteer gives this answer there. It starts from what volunteers share (some answers are easily taken for
others), mixed with the volunteer's own habit of answering as far as their accuracy is short of what careful
volunteers reach, and is corrected by their own record. A volunteer who always gives one answer, answers at
random or follows a ring therefore loses all weight, and a rare answer can win over a frequent one that is its
usual mistake. ``Settings(by_truth=False)`` gives each ballot the log odds of its volunteer's accuracy instead.

Ballots are laid out twice, as arrays: by volunteer, where they meet their weights, and by subject, where they are
summed and compared. Both sides cut them into the same blocks in the same order, so that a round sends the weights of
a block one way and the truths, as the others see them, back, without any key. A volunteer with more than a fair
share of all ballots is cut into shards, whose counts meet on the driver; a subject with more than that is cut as
well, and the sums of its shards go to all of them (at most four of either for each task).
"""

from __future__ import annotations

import math
import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import durable, parallelism, release

SUBJECT = ["workflow_id", "subject_id"]
PACKED = "at int, data binary"  # a row for each part of a layout
SENT = "to int, at int, data binary"  # a block of ballots; ``at`` is the part it comes from, or NOTE
NOTE = -1
GRID = 2.0**18  # weights are multiples of 1/GRID, exact as floats; so sums don't depend on their order, and equal votes tie


@dataclass(frozen=True)
class Settings:
    min_ballots: int = 5  # subjects with fewer take part but give no consensus row; with 1 every subject gives one
    max_rounds: int = 100  # far more than it takes; a warning is given if consensus answers still change then
    by_truth: bool = True  # weights for each possible truth; else one for each volunteer, from the accuracy alone
    prior_accuracy: float = 0.7  # smoothing of a volunteer's accuracy, worth prior_ballots
    prior_ballots: float = 2.0
    own_record: float = 12.0  # ballots after which a volunteer's own record counts as much as the mixture
    shared_record: float = 10.0


@dataclass(frozen=True)
class Consensus:
    subjects: DataFrame  # workflow_id, subject_id, task, answer, ballots, votes, share, agreement
    volunteers: DataFrame  # user_key, ballots, accuracy
    rounds: int
    changed: float  # share of consensus answers that the last round changed; above 0 in a cycle


@dataclass(frozen=True)
class _Model:
    """What all volunteers share, for each workflow: number of answers, how often each is the truth, and how often each is given to each truth."""

    sizes: dict[int, int]
    prior: dict[int, np.ndarray]
    shared: dict[int, np.ndarray]
    settings: Settings

    def care(self, w: int) -> float:
        """Share of right answers that careful volunteers reach."""
        return float((self.prior[w] * np.diag(self.shared[w])).sum())

    def base(self, most: int) -> np.ndarray:
        """Log prior of each possible truth in each workflow, padded to ``most`` answers; impossible ones get -1e18."""
        out = np.full((len(self.sizes), most), -1e18)
        for i, (w, k) in enumerate(self.sizes.items()):
            out[i, :k] = np.log(self.prior[w]) if self.shared and self.settings.by_truth else 0
        return _even(out)

    def plain(self, most: int) -> np.ndarray:
        """Weights of volunteers without a record, by truth and answer."""
        out, s = np.zeros((len(self.sizes), most, most)), self.settings
        for i, (w, k) in enumerate(self.sizes.items()):
            if s.by_truth:
                luck, best = 1 / k, self.care(w)
                r = np.clip((s.prior_accuracy - luck) / max(best - luck, 0.05), 0.02, 0.98)
                out[i, :k, :k] = np.log(np.maximum(r * self.shared[w] + (1 - r) / k, 1e-4))
            else:
                out[i, :k, :k] = np.eye(k) * _odds(np.array(s.prior_accuracy), k)
        return _even(out)


def _even(x: np.ndarray) -> np.ndarray:
    return np.round(x * GRID) / GRID


def _odds(accuracy: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    a = np.clip(accuracy, 0.02, 0.98)
    return np.log(a * np.maximum(k - 1, 1) / (1 - a))


def consensus(ballots: DataFrame, settings: Settings = Settings()) -> Consensus:
    """Consensus answers, agreement and reliability from ``operators.ballots.ballots``.

    Ties between answers go to the lowest index. Ballots with nulls are left out; a ballot must be one row for
    each volunteer, subject and workflow, and a workflow asks one task; a subject's only ballot says nothing about
    its volunteer, who keeps the prior accuracy if there are no others, and its agreement is null; an empty table
    gives empty results.
    """
    s, spark = settings, ballots.sparkSession
    votes = durable(ballots.select(*SUBJECT, "task", "n_answers", "user_key", "answer").dropna())
    asked = votes.groupBy("workflow_id").agg(F.max("n_answers").alias("k"), F.max("task").alias("task"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["workflow_id"]: r["k"] for r in sorted(asked)}  # a row for each workflow
    names = [(i, r["workflow_id"], r["task"]) for i, r in enumerate(sorted(asked))]
    named = spark.createDataFrame(names, "w int, workflow_id int, task string")
    users = durable(votes.groupBy("user_key").agg(F.count(F.lit(1)).alias("n")).withColumn("uid", F.monotonically_increasing_id()))
    laid = _laid(votes, users, named, sum(r["n"] for r in asked), max(sizes.values(), default=1))

    state = _State(None, _Model(sizes, {w: np.full(k, 1 / k) for w, k in sizes.items()}, {}, s), {})
    last = labels = None
    rounds, settled, seen = 0, not sizes, set()
    while not settled:
        truths = durable(_truths(laid, state))
        told = _told(laid, truths, state.model)
        settled = told.labels == labels
        mark = (told.mark, *((w, x.tobytes()) for w, x in sorted(told.prior.items())))
        if settled or rounds >= s.max_rounds or mark in seen:  # records and prior decide all that follows
            break
        seen.add(mark)
        last, labels = state, told.labels
        state = _State(truths, _Model(sizes, told.prior, told.shared, s), told.busy)
        rounds += 1
        release(spark)
    scores, changed = durable(_answers(laid, state)), 0.0
    if not settled and last:
        before = _answers(laid, last).select("w", "subject_id", F.col("label").alias("last"))
        changed = scores.join(before, ["w", "subject_id"]).agg(F.avg((F.col("label") != F.col("last")).cast("double"))).first()[0]
        if rounds >= s.max_rounds:
            warnings.warn(f"consensus: {changed:.2%} of the answers still change after {rounds} rounds", RuntimeWarning, stacklevel=2)
    accuracy = durable(_accuracy(laid, state)) if state.truths else None
    laid.by_user.unpersist()
    laid.by_subject.unpersist()
    return Consensus(_subjects(scores, votes, names, laid.most, s), _volunteers(accuracy, users, s), rounds, changed)


@dataclass(frozen=True)
class _Layout:
    """Ballots by volunteer and by subject, a row of arrays for each of ``parts`` (see ``_pack_users``, ``_pack_subjects``)."""

    by_user: DataFrame
    by_subject: DataFrame
    parts: int
    most: int  # answers of a workflow
    hot: list[tuple]  # for each crowded subject: w, subject_id, ballots, parts that hold its shards; the first of these owns it
    busy: frozenset[int]  # volunteers in shards


@dataclass(frozen=True)
class _State:
    """What decides a round: truths as others see them (``SENT``, none at first), the model, and the records of volunteers in shards."""

    truths: DataFrame | None
    model: _Model
    busy: dict[int, dict[tuple[int, int, int], int]]  # (w, truth, answer): ballots


def _laid(votes: DataFrame, users: DataFrame, named: DataFrame, total: int, most: int) -> _Layout:
    spark, parts = votes.sparkSession, parallelism(votes.sparkSession)
    fair = max(total / (4 * parts), 1)
    # a key for each part that Spark's own hash brings to another task
    keys = spark.range(64 * parts).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k"))
    keys = sorted(r["k"] for r in keys.collect())
    place = lambda *by: F.get(F.lit(keys), F.pmod(F.xxhash64(*by), F.lit(len(keys))).cast("int"))
    pieces = lambda n: F.ceil(n / F.lit(float(fair))).cast("int")
    # at most all ballots over ``fair``, that is four rows for each task
    heavy = votes.groupBy(*SUBJECT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fair).join(F.broadcast(named), "workflow_id")
    shards = F.transform(F.sequence(F.lit(0), pieces(F.col("n")) - 1), lambda i: place(F.col("w"), F.col("subject_id"), i))
    hot = [tuple(r) for r in heavy.orderBy("w", "subject_id").select("w", "subject_id", "n", shards).collect()]
    crowded = spark.createDataFrame([(w, x, h, math.ceil(n / fair)) for h, (w, x, n, _) in enumerate(hot)], "w int, subject_id long, hot int, shards int")
    busy = frozenset(r["uid"] for r in users.where(F.col("n") > fair).select("uid").collect())
    cut = lambda by, n: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    rows = (
        votes.join(users.select("user_key", "uid", F.when(F.col("n") > fair, pieces(F.col("n"))).alias("user_shards")), "user_key")
        .join(F.broadcast(named.select("w", "workflow_id")), "workflow_id").join(F.broadcast(crowded), ["w", "subject_id"], "left")
        .select(
            place(F.col("uid"), cut("subject_id", F.col("user_shards"))).alias("u"), place(F.col("w"), F.col("subject_id"), cut("uid", F.col("shards"))).alias("s"),
            "uid", "w", "subject_id", "answer", F.coalesce("hot", F.lit(-1)).alias("hot"),
        )
    )
    rows = durable(rows)
    packed = lambda by, pack: rows.repartition(parts, by).groupBy(by).applyInArrow(pack, PACKED).repartition(parts, "at").persist()
    return _Layout(packed("u", _pack_users), packed("s", _pack_subjects), parts, most, hot, busy)


def _ballots(table: pa.Table, own: str, other: str) -> tuple[int, dict[str, np.ndarray]]:
    """The part, and its ballots in the order that both sides know: blocks by the other side's part, in each by volunteer, workflow and subject."""
    rows = {x: table[x].to_numpy() for x in table.column_names}
    order = np.lexsort((rows["subject_id"], rows["w"], rows["uid"], rows[other]))
    rows = {x: v[order] for x, v in rows.items()}
    return int(rows[own][0]), rows


def _row(at: int, **arrays: np.ndarray) -> pa.Table:
    return pa.table({"at": pa.array([at], pa.int32()), "data": pa.array([pickle.dumps(arrays, 5)], pa.binary())})


def _pack_users(table: pa.Table) -> pa.Table:
    """``parts, sizes`` of the blocks; ``pair, answer, hot`` of each ballot; ``who, w`` of each pair of volunteer and workflow; ``uid``."""
    at, x = _ballots(table, "u", "s")
    uid, user = np.unique(x["uid"], return_inverse=True)
    most = int(x["w"].max()) + 1
    pairs, pair = np.unique(user * most + x["w"], return_inverse=True)
    parts, sizes = np.unique(x["s"], return_counts=True)
    return _row(at, parts=parts, sizes=sizes, pair=pair.astype(np.int32), answer=x["answer"], hot=x["hot"], who=pairs // most, w=pairs % most, uid=uid)


def _pack_subjects(table: pa.Table) -> pa.Table:
    """``parts, sizes`` of the blocks; ``subject`` of each ballot; ``w, subject_id, hot`` of each subject."""
    at, x = _ballots(table, "s", "u")
    order = np.lexsort((x["subject_id"], x["w"]))
    w, subject = x["w"][order], x["subject_id"][order]
    new = np.append(True, (np.diff(w) != 0) | (np.diff(subject) != 0))
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new) - 1
    parts, sizes = np.unique(x["u"], return_counts=True)
    return _row(at, parts=parts, sizes=sizes, subject=number, w=w[new], subject_id=subject[new], hot=x["hot"][order][new])


def _received(own: pa.Table, sent: pa.Table, kind: type, width: int) -> tuple[dict[str, np.ndarray] | None, np.ndarray, list[bytes]]:
    """A part's arrays, what was sent for its ballots, and the notes."""
    rows = sorted(zip(sent["at"].to_pylist(), sent["data"].to_pylist(), strict=True))
    notes, blocks = [d for at, d in rows if at == NOTE], [(at, d) for at, d in rows if at != NOTE]
    if not len(own):
        assert not blocks, "blocks for an empty part"
        return None, np.zeros((0, width), kind), notes
    x = pickle.loads(own["data"][0].as_py())
    values = np.frombuffer(b"".join(d for _, d in blocks), kind).reshape(-1, width)
    if [at for at, _ in blocks] != x["parts"].tolist() or len(values) != x["sizes"].sum():
        raise ValueError("the two layouts of the ballots differ")
    return x, values, notes


def _sent(to: list, at: list, data: list) -> pa.Table:
    return pa.table({"to": pa.array(to, pa.int32()), "at": pa.array(at, pa.int32()), "data": pa.array(data, pa.binary())})


def _blocks(at: int, x: dict[str, np.ndarray], values: np.ndarray) -> tuple[list, list, list]:
    ends = np.cumsum(x["sizes"])
    return x["parts"].tolist(), [at] * len(ends), [values[e - n : e].tobytes() for e, n in zip(ends, x["sizes"], strict=True)]


def _meet(laid: DataFrame, sent: DataFrame, parts: int, kernel, schema: str) -> DataFrame:
    """``kernel`` on each part of a layout and what was sent to it; the layout stays where it lies."""
    return laid.groupBy("at").cogroup(sent.repartition(parts, "to").groupBy("to")).applyInArrow(kernel, schema)


def _to_users(laid: _Layout, state: _State) -> DataFrame:
    nothing = laid.by_user.sparkSession.createDataFrame([], SENT)
    return nothing if state.truths is None else state.truths


def _weights(laid: _Layout, state: _State) -> DataFrame:
    """What each ballot adds to the score of every possible truth (``SENT``), and for each crowded subject the sum of a part's ballots."""
    model, most, first = state.model, laid.most, state.truths is None
    plain, shards = model.plain(most) if not first else None, [h[3] for h in laid.hot]
    busy = {u: _own(np.zeros(len(c), int), *_cells(c), 1, model, most) for u, c in state.busy.items() if c}

    def weigh(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(own):
            return _sent([], [], [])
        if first:
            x = pickle.loads(own["data"][0].as_py())
            o = (x["answer"][:, None] == np.arange(most)).astype(np.float32)
        else:
            x, truth, _ = _received(own, sent, np.int32, 1)
            told = np.nonzero(truth[:, 0] >= 0)[0]
            pair = x["pair"][told]
            who, w = x["who"], x["w"]
            table = plain[w].astype(np.float32)
            if len(told):
                user, i, found = _own(who[pair], w[pair], truth[told, 0], x["answer"][told], np.ones(len(told)), len(x["uid"]), model, most)
                table[np.searchsorted(who * len(model.sizes) + w, user * len(model.sizes) + i)] = found
            for u in np.nonzero(np.isin(x["uid"], list(busy)))[0]:
                _, i, found = busy[int(x["uid"][u])]
                for p in np.nonzero(who == u)[0]:
                    table[p] = found[i == w[p]][0] if (i == w[p]).any() else plain[w[p]]
            o = table[x["pair"], :, x["answer"]]
        to, at, data = _blocks(own["at"][0].as_py(), x, np.ascontiguousarray(o))
        for h in np.unique(x["hot"][x["hot"] >= 0]).tolist():
            note = pickle.dumps((h, o[x["hot"] == h].sum(0, dtype=float)))
            for part in sorted(set(shards[h])):
                to, at, data = [*to, part], [*at, NOTE], [*data, note]
        return _sent(to, at, data)

    return _meet(laid.by_user, _to_users(laid, state), laid.parts, weigh, SENT)


def _scored(own: pa.Table, sent: pa.Table, base: np.ndarray, hot: list[tuple]) -> tuple[dict | None, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """A part's arrays, what its ballots add, scores and ballots of its subjects, and scores of crowded ones."""
    most = base.shape[1]
    x, o, notes = _received(own, sent, np.float32, most)
    crowded: dict[int, np.ndarray] = {}
    for h, z in map(pickle.loads, notes):
        crowded[h] = crowded.get(h, 0) + z
    crowded = {h: z + base[hot[h][0]] for h, z in crowded.items()}
    if x is None:
        return x, o, np.zeros((0, most)), np.zeros(0, int), crowded
    z = np.stack([np.bincount(x["subject"], weights=o[:, t], minlength=len(x["w"])) for t in range(most)], 1) + base[x["w"]]
    n = np.bincount(x["subject"], minlength=len(x["w"]))
    for i in np.nonzero(x["hot"] >= 0)[0]:
        z[i], n[i] = crowded[x["hot"][i]], hot[x["hot"][i]][2]
    return x, o, z, n, crowded


def _labels(at: int, x: dict | None, z: np.ndarray, n: np.ndarray, crowded: dict, hot: list[tuple]) -> list[np.ndarray]:
    """``w, subject_id, n, label`` of the subjects that a part owns."""
    mine = [h for h in sorted(crowded) if hot[h][3][0] == at]
    last = [np.array([v(h) for h in mine], np.int64) for v in (lambda h: hot[h][0], lambda h: hot[h][1], lambda h: hot[h][2], lambda h: crowded[h].argmax())]
    if x is None:
        return last
    cold = x["hot"] < 0
    return [np.concatenate([a[cold], b]) for a, b in zip((x["w"], x["subject_id"], n, z.argmax(1)), last, strict=True)]


def _truths(laid: _Layout, state: _State) -> DataFrame:
    """For each ballot the truth as the others on its subject see it, or -1 for a subject's only one; and a note on the labels of each part."""
    base, hot, sizes = state.model.base(laid.most), laid.hot, list(state.model.sizes.values())

    def compare(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        at = key[0].as_py()
        x, o, z, n, crowded = _scored(own, sent, base, hot)
        w, subject, _, label = _labels(at, x, z, n, crowded, hot)
        note = pickle.dumps((np.bincount(w * max(sizes) + label, minlength=len(sizes) * max(sizes)), _hash(w, subject, label)))
        to, come, data = [at], [NOTE], [note]
        if x is not None:
            truth = np.where(n[x["subject"]] >= 2, (z[x["subject"]] - o).argmax(1), -1).astype(np.int32)
            to, come, data = (a + b for a, b in zip((to, come, data), _blocks(at, x, truth), strict=True))
        return _sent(to, come, data)

    return _meet(laid.by_subject, _weights(laid, state), laid.parts, compare, SENT)


def _answers(laid: _Layout, state: _State) -> DataFrame:
    """``w, subject_id, n, label`` of every subject."""
    base, hot = state.model.base(laid.most), laid.hot

    def answer(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        w, subject, n, label = _labels(key[0].as_py(), *(lambda x, o, z, n, c: (x, z, n, c))(*_scored(own, sent, base, hot)), hot)
        return pa.table({"w": w.astype(np.int32), "subject_id": subject.astype(np.int64), "n": n.astype(np.int64), "label": label.astype(np.int32)})

    return _meet(laid.by_subject, _weights(laid, state), laid.parts, answer, "w int, subject_id long, n long, label int")


def _hash(*columns: np.ndarray) -> int:
    """Of a set of rows, whatever their order."""
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = x * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return int(x.sum(dtype=np.uint64)) if len(x) else 0


def _counts(x: dict[str, np.ndarray], truth: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """``user, w, truth, answer, n`` of a part's ballots; those that stand alone have truth -1."""
    cell, n = np.unique((x["pair"].astype(np.int64) * (most + 1) + truth + 1) * most + x["answer"], return_counts=True)
    rest, answer = np.divmod(cell, most)
    pair, truth = np.divmod(rest, most + 1)
    return x["who"][pair], x["w"][pair], truth - 1, answer, n


def _accuracies(users: int, user: np.ndarray, truth: np.ndarray, answer: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    """Smoothed leave-one-out accuracy of each volunteer."""
    p, m = settings.prior_accuracy, settings.prior_ballots
    hits, told = (np.bincount(user, weights=n * c, minlength=users) for c in (truth == answer, truth >= 0))
    return (hits + p * m) / (told + m)


@dataclass(frozen=True)
class _Told:
    shared: dict[int, np.ndarray]
    prior: dict[int, np.ndarray]
    busy: dict[int, dict[tuple[int, int, int], int]]
    mark: int  # fingerprint of all records
    labels: int  # fingerprint of all consensus answers


def _told(laid: _Layout, truths: DataFrame, model: _Model) -> _Told:
    """How often each answer is given to each truth (accurate volunteers count more) and how often each is the consensus, for each workflow."""
    most, busy, settings = laid.most, laid.busy, model.settings

    def count(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        x, truth, notes = _received(own, sent, np.int32, 1)
        cells, mark, held = {}, 0, []
        if x is not None:
            user, w, t, a, n = _counts(x, truth[:, 0], most)
            apart = np.isin(x["uid"], list(busy))[user]
            held = list(zip(*(v[apart].tolist() for v in (x["uid"][user], w, t, a, n)), strict=True))
            weight = np.round(_accuracies(len(x["uid"]), user, t, a, n, settings) ** 2 * GRID)[user] * n
            use = ~apart & (t >= 0)
            cell, at = np.unique((w[use].astype(np.int64) * most + t[use]) * most + a[use], return_inverse=True)
            cells = dict(zip(cell.tolist(), np.bincount(at, weights=weight[use], minlength=len(cell)).tolist(), strict=True))
            mark = _hash(*(v[~apart] for v in (x["uid"][user], w, t, a, n)))
        return pa.table({"data": pa.array([pickle.dumps((cells, mark, held, [pickle.loads(d) for d in notes]))], pa.binary())})

    sums, mark, records, labels, heads = {}, 0, {u: {} for u in busy}, 0, 0
    for r in _meet(laid.by_user, truths, laid.parts, count, "data binary").collect():  # for each part, workflows times answers squared
        cells, part, held, notes = pickle.loads(r["data"])
        mark += part
        for c, x in cells.items():
            sums[c] = sums.get(c, 0.0) + x
        for u, *cell, n in held:
            records[u][tuple(cell)] = records[u].get(tuple(cell), 0) + n
        for counted, x in notes:
            heads, labels = heads + counted, labels + x
    for u, record in sorted(records.items()):
        w, t, a, n = _cells(record)
        weight = np.round(_accuracies(1, np.zeros(len(n), int), t, a, n, settings)[0] ** 2 * GRID) * n
        for i in np.nonzero(t >= 0)[0]:
            c = int((w[i] * most + t[i]) * most + a[i])
            sums[c] = sums.get(c, 0.0) + float(weight[i])
        mark += _hash(np.full(len(n), u), w, t, a, n)
    shared, prior = {}, {}
    for i, (w, k) in enumerate(model.sizes.items()):
        rest = (1 - settings.prior_accuracy) / max(k - 1, 1)
        shared[w] = settings.shared_record * (np.full((k, k), rest) + np.eye(k) * (settings.prior_accuracy - rest))
        for t in range(k):
            for a in range(k):
                shared[w][t, a] += sums.get((i * most + t) * most + a, 0.0) / GRID
        prior[w] = 1.0 + heads.reshape(len(model.sizes), most)[i, :k]
    told = {u: {c: n for c, n in r.items() if c[1] >= 0} for u, r in records.items()}
    return _Told({w: c / c.sum(1, keepdims=True) for w, c in shared.items()}, {w: p / p.sum() for w, p in prior.items()}, told, mark % 2**64, labels % 2**64)


def _cells(record: dict[tuple[int, int, int], int]) -> tuple[np.ndarray, ...]:
    rows = np.array([(*c, n) for c, n in sorted(record.items())], np.int64).reshape(-1, 4)
    return tuple(rows.T)


def _accuracy(laid: _Layout, state: _State) -> DataFrame:
    """``uid, accuracy`` of every volunteer."""
    most, busy, settings, spark = laid.most, laid.busy, state.model.settings, laid.by_user.sparkSession

    def measure(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        x, truth, _ = _received(own, sent, np.int32, 1)
        if x is None:
            return pa.table({"uid": pa.array([], pa.int64()), "accuracy": pa.array([], pa.float64())})
        user, _, t, a, n = _counts(x, truth[:, 0], most)
        mine = ~np.isin(x["uid"], list(busy))
        return pa.table({"uid": x["uid"][mine], "accuracy": _accuracies(len(x["uid"]), user, t, a, n, settings)[mine]})

    cut = []
    for u, record in state.busy.items():
        _, t, a, n = _cells(record)
        cut.append((u, float(_accuracies(1, np.zeros(len(n), int), t, a, n, settings)[0])))
    return _meet(laid.by_user, state.truths, laid.parts, measure, "uid long, accuracy double").unionByName(spark.createDataFrame(cut, "uid long, accuracy double"))


def _own(who: np.ndarray, w: np.ndarray, t: np.ndarray, a: np.ndarray, n: np.ndarray, users: int, model: _Model, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Volunteer, workflow and the weights of every answer for every truth, for each pair of them in a record."""
    s, names = model.settings, list(model.sizes)
    size = np.array([model.sizes[x] for x in names])
    flat, chance, even = np.zeros((len(names), most, most)), np.zeros((len(names), most)), np.zeros((len(names), most))
    for i, x in enumerate(names):
        k = size[i]
        flat[i, :k, :k], chance[i, :k], even[i, :k] = model.shared[x], model.prior[x], 1 / k
    care = np.array([model.care(x) for x in names])
    pair, row = np.unique(who * len(names) + w, return_inverse=True)  # only the workflows that a volunteer took part in
    hits = np.bincount(who, weights=n * (t == a), minlength=users)
    told = np.bincount(who, weights=n, minlength=users)
    accuracy = (hits + s.prior_accuracy * s.prior_ballots) / (told + s.prior_ballots)
    who, i = pair // len(names), pair % len(names)
    record = np.bincount((row * most + t) * most + a, weights=n, minlength=len(pair) * most * most).reshape(-1, most, most)
    given = record.sum(1)
    total = given.sum(1)
    habit = (given + 2 * even[i]) / (total[:, None] + 2)
    of = lambda v: np.bincount(who, weights=v, minlength=users) / np.maximum(told, 1)
    best, luck = of(total * care[i]), of(total * (habit * chance[i]).sum(1))
    if s.by_truth:
        r = np.clip((accuracy - luck) / np.maximum(best - luck, 0.05), 0.02, 0.98)[who][:, None, None]
        mixed = r * flat[i] + (1 - r) * habit[:, None, :]
        chances = (record + s.own_record * mixed) / (record.sum(2, keepdims=True) + s.own_record)
        own = np.log(np.maximum(chances, 1e-4))
    else:
        own = np.eye(most)[None] * _odds(accuracy[who], size[i])[:, None, None]
    return who, i, _even(own).astype(np.float32)


def _subjects(scores: DataFrame, votes: DataFrame, names: list[tuple], most: int, settings: Settings) -> DataFrame:
    """Consensus rows. ``agreement`` corrects the share of agreeing pairs for chance, like Krippendorff's alpha does for missing ratings.

    Only subjects with two ballots or more have pairs: ballots that stand alone count neither as agreement (it is
    null for them) nor towards the chance of it, which is that of two random paired ballots of the workflow.
    Agreement 1 is unanimity, 0 what chance gives.
    """
    named = votes.sparkSession.createDataFrame(names, "w int, workflow_id int, task string")  # a row for each workflow, as in chance
    counted = votes.groupBy(*SUBJECT).agg(*(F.count_if(F.col("answer") == t).alias(f"c{t}") for t in range(most)))
    counted = durable(counted.select(*SUBJECT, F.array(*(F.col(f"c{t}") for t in range(most))).alias("counts")).join(scores.join(F.broadcast(named), "w").drop("w"), SUBJECT))
    n = F.col("n").cast("double")
    pairs = F.aggregate("counts", F.lit(0.0), lambda s, c: s + c * (c - 1)) / F.nullif(n * (n - 1), F.lit(0.0))
    answers = counted.where("n >= 2").select("workflow_id", F.posexplode("counts").alias("a", "c")).groupBy("workflow_id", "a").agg(F.sum("c").alias("c"))
    chance = answers.groupBy("workflow_id").agg((F.sum(F.col("c") * (F.col("c") - 1.0))).alias("same"), F.sum("c").alias("all")).select(
        "workflow_id", (F.col("same") / F.nullif(F.col("all") * (F.col("all") - 1.0), F.lit(0.0))).alias("e")
    )
    cast = F.get("counts", F.col("label"))
    return (
        counted.where(F.col("n") >= settings.min_ballots).join(F.broadcast(chance), "workflow_id", "left")
        .select(
            *SUBJECT, "task", F.col("label").alias("answer"), F.col("n").alias("ballots"),
            cast.alias("votes"), (cast / n).alias("share"),
            F.when(F.col("n") < 2, None).when(F.col("e") < 1, (pairs - F.col("e")) / (1 - F.col("e"))).otherwise(1.0).alias("agreement"),
        )
    )


def _volunteers(accuracy: DataFrame | None, users: DataFrame, settings: Settings) -> DataFrame:
    if accuracy is None:
        return users.select("user_key", F.col("n").alias("ballots"), F.lit(settings.prior_accuracy).alias("accuracy"))
    return users.join(accuracy, "uid", "left").select("user_key", F.col("n").alias("ballots"), F.coalesce("accuracy", F.lit(settings.prior_accuracy)).alias("accuracy"))
