"""A training mixture whose sources have target shares of its size in tokens.

Method: multivariate-hypergeometric splitting tree. Documents are dealt into blocks by a seeded hash, so a block is
a random part of its source. Each source gets an exact quota: some whole passes over its blocks, then blocks in
their random order, and of one last block the documents that still fit. The number of block uses of each source
is split among the output shards by a binary tree: each node hands a random half of its uses to either side,
drawn without replacement, so every shard is a fair sample of the mixture and no use is dealt twice. Shards then
take disjoint runs of each source's block uses and shuffle their documents locally.

The driver handles block counts only (at most ``max_blocks``, whatever the corpus), never documents. A source
with a third of all rows is spread over its blocks like any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import broadcast_if_small, durable

from .tokens import FOLDER, RANKS, sized
from .truncation import plain_source


@dataclass(frozen=True)
class Settings:
    budget: int | None = None  # tokens; None: the largest total at which every source with documents has its share
    budget_share: float | None = None  # in place of a budget: its part of all tokens of the sources with targets
    block_tokens: int = 20_000  # of an average block, unless that makes more than max_blocks
    max_blocks: int = 100_000
    shard_tokens: int = 2_000_000  # of an average shard, but at least shard_blocks blocks
    shard_blocks: int = 50
    seed: int = 20_210_301
    tokenizer_folder: str = FOLDER
    ranks: str = RANKS
    broadcast_rows: int = 500_000  # block uses up to which the plan is broadcast


@dataclass(frozen=True)
class Mixture:
    documents: DataFrame  # shard, position, doc_id, source, use, tokens
    shares: DataFrame  # source, target_share, actual_share, tokens, quota, available, documents, max_uses, max_repeats, met


def quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None) -> dict[str, int]:
    """Tokens for each source: share times total, at most ``max_repeats`` times what there is.

    Without a budget the total is the largest at which no source with documents falls short. With one, what short
    sources leave goes to the others in proportion to their shares, as far as their repeats allow.
    """
    caps = {s: available.get(s, 0) * r for s, (_, r) in targets.items() if available.get(s, 0) * r > 0}
    shares = {s: targets[s][0] for s in caps if targets[s][0] > 0}
    if not shares:
        return {}
    if budget is None:
        level = min(caps[s] / p for s, p in shares.items())
    else:
        level, left, free = 0.0, float(min(budget, sum(caps[s] for s in shares))), dict(shares)
        while free and left > 0:
            step = left / sum(free.values())
            full = {s for s, p in free.items() if p * step >= caps[s]}
            if not full:
                level = step
                break
            left -= sum(caps[s] for s in full)
            free = {s: p for s, p in free.items() if s not in full}
        else:
            level = math.inf
    return {s: int(min(caps[s], math.floor(p * level))) if level < math.inf else caps[s] for s, p in shares.items()}


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shard, source) numbers of block uses that add up to ``counts``, by recursive hypergeometric halving."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    draw = int(counts.sum() * left // shards)
    taken = rng.multivariate_hypergeometric(counts, draw, method="marginals") if counts.sum() else counts
    return np.concatenate([split(taken, left, rng), split(counts - taken, shards - left, rng)])


def mixture(documents: DataFrame, targets: DataFrame, settings: Settings = Settings()) -> Mixture:
    """The mixture and the shares it reaches, from ``doc_id, source, text`` and ``source, target_share, max_repeats``.

    Source names match regardless of letter case, outer blanks and blanks for underscores. Documents without id,
    text or tokens, of no source or of one without target are not drawn (the latter are reported without target);
    an id counts once; null, zero or negative shares and repeats give no quota; targets named twice add up, with
    the lower repeats. Texts are drawn whole, so a source may miss its quota by less than its largest document.
    Empty tables give empty results; other columns are ignored.
    """
    s = settings
    spark = documents.sparkSession
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(
        "doc_id", plain_source(F.col("source")).alias("source"), "text"
    )
    sizes = durable(sized(rows, s.tokenizer_folder, s.ranks).where("tokens > 0").dropDuplicates(["doc_id"]))
    wanted = {
        r["source"]: (float(r["p"]), int(r["r"]))  # a row for each source of the target table
        for r in targets.where("target_share > 0 AND max_repeats > 0").groupBy(plain_source(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("p"), F.min("max_repeats").alias("r")).collect()
    }
    named = spark.createDataFrame(sorted((n, p, r) for n, (p, r) in wanted.items()), "source string, target_share double, max_repeats int")
    mixed = sizes.join(F.broadcast(named.select("source")), "source")
    available = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    budget = s.budget if s.budget_share is None else int(s.budget_share * sum(available.values()))
    quota = quotas(available, wanted, budget)
    per_block = max(s.block_tokens, math.ceil(sum(available.values()) / s.max_blocks * 2))
    n_blocks = {n: max(1, math.ceil(available[n] / per_block)) for n in quota}
    if not quota:
        empty = spark.createDataFrame([], "shard int, position long, doc_id long, source string, use int, tokens long")
        return Mixture(empty, _shares(sizes, named, empty, quota))

    order = F.xxhash64(F.lit(s.seed), "source", "doc_id")
    counts = F.create_map(*(x for n, k in n_blocks.items() for x in (F.lit(n), F.lit(k))))
    dealt = mixed.where(F.col("source").isin(list(quota))).select(
        "doc_id", "source", "tokens", order.alias("o"), F.pmod(order, counts[F.col("source")]).cast("int").alias("block")
    )
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("t")).collect()  # at most max_blocks
    plan = _plan(blocks, available, quota, per_block, s)
    uses = spark.createDataFrame(plan, "source string, block int, use int, shard int, room long")
    drawn = dealt.join(broadcast_if_small(uses, len(plan), s.broadcast_rows), ["source", "block"])
    whole = drawn.where("room IS NULL").drop("room")
    # of each source's last block: documents in random order while they fit
    last = drawn.where("room IS NOT NULL")
    inside = Window.partitionBy("source", "block").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = last.withColumn("filled", F.sum("tokens").over(inside)).where("filled <= room").drop("room", "filled")  # one block each
    local = F.row_number().over(_shard_order(s.seed)) - 1
    shards = max(r[3] for r in plan) + 1
    out = durable(
        whole.unionByName(fits).repartition(shards, "shard").select("shard", local.cast("long").alias("position"), "doc_id", "source", "use", "tokens")
    )
    return Mixture(out, _shares(sizes, named, out, quota))


def _shard_order(seed: int):
    return Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "use"), "doc_id", "use")


def _plan(blocks, available: dict[str, int], quota: dict[str, int], per_block: int, s: Settings) -> list[tuple]:
    """(source, block, use, shard, room) for every use of a block; ``room`` is set where only part of it fits.

    Shards grow with the blocks, so there are at most 1/``shard_blocks`` as many as uses of blocks, whatever the corpus.
    """
    sizes: dict[str, list[tuple[int, int]]] = {n: [] for n in quota}
    for r in blocks:
        sizes[r["source"]].append((r["block"], r["t"]))
    sources = sorted(quota)
    uses: dict[str, list[tuple[int, int, int | None]]] = {}
    for n in sources:
        passes, rest = divmod(quota[n], available[n])
        uses[n] = [(block, k, None) for k in range(passes) for block, _ in sorted(sizes[n])]
        for block, size in sorted(sizes[n]):
            if rest <= 0:
                break
            uses[n].append((block, passes, None if size <= rest else rest))
            rest -= size
    shards = max(1, math.ceil(sum(quota.values()) / max(s.shard_tokens, s.shard_blocks * per_block)))
    rng = np.random.default_rng(s.seed)
    table = split(np.array([len(uses[n]) for n in sources], dtype=np.int64), shards, rng)
    plan = []
    for j, n in enumerate(sources):
        permuted = [uses[n][i] for i in rng.permutation(len(uses[n]))]
        ends = np.cumsum(table[:, j])
        plan += [
            (n, int(block), int(use), shard, room)
            for shard, end in enumerate(ends)
            for block, use, room in permuted[end - table[shard, j] : end]
        ]
    return plan


def _shares(sizes: DataFrame, named: DataFrame, drawn: DataFrame, quota: dict[str, int]) -> DataFrame:
    """One row for each source of the documents or the targets."""
    spark = sizes.sparkSession
    per_doc = drawn.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    used = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("max_uses"))
    total = used.agg(F.sum("tokens").alias("all"))
    there = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.max("tokens").alias("largest"))
    quotas_ = spark.createDataFrame(sorted(quota.items()), "source string, quota long")
    joined = named.join(there, "source", "full").join(used, "source", "left").join(quotas_, "source", "left").crossJoin(F.broadcast(total))  # one row
    tokens, got = F.coalesce("tokens", F.lit(0)), F.coalesce("quota", F.lit(0))
    share = F.when(F.col("all") > 0, tokens / F.col("all")).otherwise(0.0)
    return joined.select(
        "source", "target_share", share.alias("actual_share"), tokens.alias("tokens"), got.alias("quota"),
        F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("max_uses", F.lit(0)).alias("max_uses"), "max_repeats",
        F.when(F.col("target_share").isNotNull(), F.abs(share - F.col("target_share")) <= 0.01).alias("met"),
    )
