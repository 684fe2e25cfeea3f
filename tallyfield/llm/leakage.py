"""Passages of held-out items inside a corpus.

Method: prefix-filtered set join. Texts become word shingles. Of every window of an item that is as long as the
shortest passage that counts, a passage with single changed words must keep a minimum of shingles, so it keeps at
least one of the window's rarest ones: only this prefix, with shingles ordered by how many documents hold them,
is joined with the corpus. A hit fixes the passage's position (document position less item position); hits
whose overlap is too short are dropped, and every remaining position is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import words
from tallyfield.session import broadcast_if_small, durable, once


@dataclass(frozen=True)
class Settings:
    passage: int = 20  # words of the shortest passage that counts
    changed: int = 5  # single words that may differ in a passage of that length
    shingle: int = 3
    stock_items: int = 3  # items that share a first sentence for it to be an instruction line
    broadcast_rows: int = 200_000  # item shingles up to which they are broadcast; beyond, a shuffled join

    @property
    def kept(self) -> int:
        """Shingles of a passage that its changed words leave intact, at least."""
        return self.passage - self.shingle + 1 - self.changed * self.shingle


def item_words(items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, w``: the words of each item without its instruction line.

    An instruction line is a first sentence or line that at least ``stock_items`` items share; an item that is
    nothing but such a line has no words left.
    """
    first = F.regexp_extract("text", r"(?s)^\s*(.+?(?:[.!?:](?=\s|$)|\n|$))(.*)$", 1)
    rest = F.regexp_extract("text", r"(?s)^\s*(.+?(?:[.!?:](?=\s|$)|\n|$))(.*)$", 2)
    split = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        "item_id", words(F.col("text")).alias("all"), words(first).alias("first"), words(rest).alias("rest")
    )
    stock = split.where(F.size("first") > 0).groupBy("first").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") >= settings.stock_items)
    return split.join(stock, "first", "left").select("item_id", F.when(F.col("n").isNull(), F.col("all")).otherwise(F.col("rest")).alias("w"))


def shingles(w: Column, size: int) -> Column:
    """Array of hashes of ``size`` words in a row; empty for shorter texts."""
    last = F.size(w) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))


def leaks(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, passage, changed``: the longest passage of each item in each document that holds one.

    A passage is a run of at least ``passage`` item words in the document, in place, where no two neighbouring
    words differ and no stretch of that length has more than ``changed`` that do. Null, empty and shorter texts
    hold none; repeated documents and items are found each under their own id, repeated ids once; texts of any
    length are searched whole; empty tables give an empty result; columns of other names are ignored.
    """
    if settings.kept < 1:
        raise ValueError("passages with so many changed words need not keep a shingle")
    n = settings.shingle
    item = durable(item_words(items, settings).where(F.size("w") >= settings.passage).dropDuplicates(["item_id"]))
    at_item = item.select("item_id", F.size("w").alias("m"), F.posexplode(shingles(F.col("w"), n)).alias("q", "s"))
    wanted = durable(at_item.select("s").distinct())
    doc = once(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), "w", words(F.col("text"))).drop("text")
    doc = doc.where(F.size("w") >= settings.passage)
    at_doc = doc.select("doc_id", F.size("w").alias("d"), F.posexplode(shingles(F.col("w"), n)).alias("p", "s"))
    hits = durable(at_doc.join(broadcast_if_small(wanted, wanted.count(), settings.broadcast_rows), "s"))

    # shingles by rarity over the whole corpus; of each item window the rarest that must hold one that is kept
    held = hits.groupBy("s").agg(F.count_distinct("doc_id").alias("df"))
    span = settings.passage - n + 1
    ranked = at_item.join(held, "s", "left").groupBy("item_id", "m").agg(
        F.sort_array(F.collect_list(F.struct("q", F.coalesce("df", F.lit(0)).alias("df"), "s"))).alias("all")
    )  # one row for each item, as long as the item
    prefix = (
        ranked.select("item_id", "m", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("all") - span),
            lambda i: F.slice(F.array_sort(F.transform(F.slice("all", i + 1, span), lambda x: F.struct(x["df"], x["s"], x["q"]))), 1, span - settings.kept + 1),
        )).alias("window"))
        .select("item_id", "m", F.inline("window")).select("item_id", "m", "s", "q").distinct()
    )
    offset = F.col("p") - F.col("q")
    overlap = F.least("m", F.col("d") - offset) - F.greatest(F.lit(0), -offset)
    candidates = (
        hits.join(prefix, "s").select("doc_id", "item_id", offset.alias("o"), overlap.alias("overlap"))
        .where(F.col("overlap") >= settings.passage).groupBy("doc_id", "item_id").agg(F.collect_set("o").alias("offsets"))
    )
    candidates = durable(candidates)
    held_by = candidates.select("doc_id").distinct()
    few = documents.where("text IS NOT NULL").select("doc_id", "text").join(held_by, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = once(few, "w", words(F.col("text"))).drop("text")
    checked = candidates.join(texts, "doc_id").join(item.withColumnRenamed("w", "v"), "item_id")
    out = checked.select("doc_id", "item_id", "offsets", "w", "v").mapInArrow(_verify(settings), "doc_id long, item_id long, passage int, changed int")
    kinds = {f.name: f.dataType for f in checked.schema.fields}
    return out.select(F.col("doc_id").cast(kinds["doc_id"]), F.col("item_id").cast(kinds["item_id"]), "passage", "changed")


def _verify(settings: Settings):
    """Candidates (``doc_id, item_id, offsets, w, v``) to the longest passage of each, where that is long enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item = batch.column("w"), batch.column("v")
            # equal words get equal numbers, so that whole stretches are compared at once
            numbered = pa.concat_arrays([doc.flatten(), item.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            ends = [np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]) for x in (doc, item)]
            words, rest = numbered[: ends[0][-1]], numbered[ends[0][-1] :]
            found = []
            for n, offsets in enumerate(batch.column("offsets").to_pylist()):
                w, v = words[ends[0][n] : ends[0][n + 1]], rest[ends[1][n] : ends[1][n + 1]]
                best = max((longest(w, v, o, settings) for o in offsets), default=(0, 0))
                if best[0] >= settings.passage:
                    found.append((n, *best))
            rows, run, changed = zip(*found, strict=True) if found else ((), (), ())
            at = pa.array(rows, pa.int64())
            ids = [batch.column(c).take(at).cast(pa.int64()) for c in ("doc_id", "item_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(run, pa.int32()), pa.array(changed, pa.int32())], names=["doc_id", "item_id", "passage", "changed"])

    return verify


def longest(w: np.ndarray, v: np.ndarray, o: int, settings: Settings) -> tuple[int, int]:
    """(words, changed ones) of the longest passage with item word q beside document word q + o.

    It begins and ends with an equal word, has no two changed ones in a row and at most ``changed`` in any stretch of
    ``passage`` words; only the changed places are gone through one by one.
    """
    low, high = max(0, -o), min(len(v), len(w) - o)
    if high - low < settings.passage:
        return 0, 0
    differ = np.nonzero(v[low:high] != w[low + o : high + o])[0] + low
    if high - low - len(differ) < settings.passage - settings.changed:
        return 0, 0
    begin, recent, before, best = -1, [], low - 1, (0, 0)
    for q in [*differ.tolist(), high]:
        if q > before + 1:
            begin = before + 1 if begin < 0 else begin
            best = max(best, (q - begin, int(np.searchsorted(differ, q) - np.searchsorted(differ, begin))))
        if begin >= 0 and (not recent or recent[-1] != q - 1):
            recent = [c for c in recent if c > q - settings.passage]
            if len(recent) >= settings.changed:  # one too many: the run goes on behind its first recent change
                begin, recent = recent[0] + 1, recent[1:]
            recent.append(q)
        else:  # a second changed word in a row
            begin, recent = -1, []
        before = q
    return best
