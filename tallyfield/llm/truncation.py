"""Texts that stop before their author had finished.

Method, in two steps.

Storage limits: every text's length is recomputed under the encodings a store may have counted in (characters,
UTF-8 bytes, UTF-16 units, with HTML entities, with JSON escapes, with CR LF line ends). Grouped by source and
measure, a hidden limit shows as a length that many more open-ended texts have than the lengths around it.

Endings: over the whole corpus it is counted how often each run of up to ``order`` words is followed by the end of
a sentence or line, and how often by another word. A text's last words then tell how likely its ending is an
end; a last word that elsewhere only occurs as the beginning of longer words in its place is cut; closing
formulas (signatures, tags, greetings) are known by their opening words, which occur nowhere but in last
sentences. Words that few documents share (names, numbers) count as one class. A text is reported if, given
these and the share of cut texts among open endings (re-estimated until it fits itself; at a limit, from the
excess there), being cut is likelier than being finished.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import durable


@dataclass(frozen=True)
class Settings:
    order: int = 5  # words of context
    backing: float = 2.0  # occurrences that the shorter context counts for
    lexicon_share: float = 0.002  # share of documents that must hold a word for it to count by itself
    lexicon_least: int = 5
    tail: int = 30  # words by which reposted endings are recognised, so that they count once
    formula_words: int = 8
    formula_share: float = 0.8
    formula_least: int = 3
    limit_least: int = 5  # open endings of one length that make a limit
    limit_excess: float = 8.0  # times what the lengths around it have
    word_room: int = 15  # characters below a limit in which a text cut at a word's start may end


TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?]+|\n|[^\w\s]")
OMISSION = re.compile(r"(?:\s*(?:\.\.\.+|…|[\[(](?:…|\.\.\.)[\])]))+\s*$")
CLOSING_TAGS = re.compile(r"(?:\s*</?[A-Za-z][^<>]*>)+\s*$")
CLOSERS = "\"”»)]'’*_"
SIGNATURE = re.compile(r"^(—|–|--|~|-)\s?\S+(\s\S+)?$")
HASH_TAG = re.compile(r"(^|\s)#\w+$")
DRAWN_OUT = re.compile(r"(\w)\1\1\1")
OPEN_MARKS = set(",;:-–—/&@(“«<")
RARE, STOP, START = "<x>", "$", "^"


def tokens(text: str) -> list[str]:
    """Words in lower case, ``0`` for numbers, marks, ``$`` at the end of a sentence, ``$ ^`` at the end of a line."""
    out = [START]
    for m in TOKEN.finditer(text.lower()):
        x = m.group()
        if x == "\n":
            if out[-1] != START:
                out += [START] if out[-1] == STOP else [STOP, START]
        elif x[0] in ".!?":
            if out[-1] not in (STOP, START):
                out.append(STOP)
        else:
            out.append("0" if x[0].isdigit() else x)
    return out


def bare(text: str) -> tuple[str, bool]:
    """Text without closing tags and marks of omission at its end, and whether there were such marks."""
    body = CLOSING_TAGS.sub("", text)
    return OMISSION.sub("", body).rstrip(), bool(OMISSION.search(body))


def rule(body: str, omitted: bool, toks: list[str]) -> str | None:
    """The kind of an ending that needs no statistics, else None."""
    end = body.rstrip(CLOSERS + " ")
    if end and end[-1] in ".!?" and not omitted:
        return "stop"
    if not toks:
        return "empty"
    if HASH_TAG.search(body):
        return "tag"
    if SIGNATURE.match(body.rsplit("\n", 1)[-1].strip()):
        return "signature"
    last = toks[-1]
    if not last[0].isalnum() and last not in OPEN_MARKS:
        return "sign"
    return "drawn out" if DRAWN_OUT.search(last) else None


def _hashes(ids: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order`` a 64-bit hash of the ids that end at each place (valid from place length-1)."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out, run = [], np.zeros(len(ids), np.uint64)
    for k in range(order):
        shifted = np.zeros(len(ids), np.uint64)
        shifted[k:] = mixed[: len(ids) - k] if k else mixed
        run = (run ^ (shifted + np.uint64(k + 1))) * np.uint64(0xBF58476D1CE4E5B9)
        run ^= run >> np.uint64(29)
        out.append(run.copy())
    return out


def _word_id(word: str) -> int:
    """A stable 64-bit number for a word."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode())


class _Corpus:
    """Shared by the passes over batches: from tokens to ids with rare words as one class."""

    def __init__(self, lexicon: list[str], settings: Settings):
        self.ids = {w: _word_id(w) for w in [*lexicon, STOP, START, "0"]}
        self.rare, self.settings = _word_id(RARE), settings

    def classed(self, toks: list[str]) -> np.ndarray:
        get, rare = self.ids.get, self.rare
        return np.array([i if (i := get(w)) is not None else rare if w[0].isalpha() else _word_id(w) for w in toks], np.uint64)

    def opener(self, word: str, hashes: list[np.ndarray], at: int, end: int) -> int:
        """What a sentence opens with: its first two words, or a rare first word by itself."""
        if word not in self.ids:
            return _word_id(f"{START} {word}")
        return int(hashes[1][at + 1]) if at + 1 < end else int(hashes[0][at])


def _texts(pdf: pd.DataFrame) -> Iterator[tuple[int, str, bool, list[str]]]:
    for n, text in enumerate(pdf["text"]):
        body, omitted = bare(text)
        yield n, body, omitted, tokens(body)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        held: Counter[str] = Counter()
        for _, _, _, toks in _texts(pdf):
            held.update({w for w in toks if w[0].isalpha()})
        yield pd.DataFrame({"w": list(held), "n": list(held.values())}, columns=["w", "n"])


def _lexicon(texts: DataFrame, total: int, settings: Settings) -> list[str]:
    """Words in at least ``lexicon_share`` of the documents: at most the mean words of a document over that share."""
    least = max(settings.lexicon_least, settings.lexicon_share * total)
    counts = texts.mapInPandas(_word_counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r["w"] for r in counts.where(F.col("n") >= least).select("w").collect()]


def _counts(corpus: _Corpus, least_prefix: int = 1):
    """Pass over the corpus: (kind, hash, tail, n, ends); kinds are c(ontext), b(igram), p(refix of a bigram's second word), o(pener)."""
    order, tail = corpus.settings.order, corpus.settings.tail
    stop, start = corpus.ids[STOP], corpus.ids[START]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            inner, inner_ends = [], []
            rows: list[pd.DataFrame] = []
            pairs: Counter[tuple[int, str]] = Counter()
            last: list[tuple[str, int, int]] = []
            openers: Counter[int] = Counter()
            for _, _, _, toks in _texts(pdf):
                ids = corpus.classed(toks)
                while len(ids) and ids[-1] in (stop, start):
                    ids = ids[:-1]  # a final stop is no event: only the corpus inside texts tells what ends a sentence
                n = len(ids)
                if not n:
                    continue
                finished = n < len(toks)
                key = _word_id(" ".join(toks[max(0, n - tail) : n]))
                hs = _hashes(ids, order)
                word = (ids != stop) & (ids != start)
                ends = np.zeros(n, bool)
                ends[:-1] = ids[1:] == stop
                inside = word.copy()
                inside[-1] = finished
                ends[-1] = True
                for k in range(order):
                    pick = np.nonzero(inside[k:])[0] + k
                    inner.append(hs[k][pick])
                    inner_ends.append(ends[pick])
                    if not finished and n > k:
                        last.append(("c", int(hs[k][-1]), key))
                for i in range(1, n - (not finished)):
                    if toks[i][0].isalpha():
                        pairs[(int(ids[i - 1]), toks[i])] += 1
                begins = [i for i in range(n) if ids[i] in (stop, start) and i + 1 < n and word[i + 1]]
                for i in begins:
                    opener = corpus.opener(toks[i + 1], hs, i + 1, n)
                    if i == begins[-1] and not finished:
                        last.append(("o", opener, key))
                    else:
                        openers[opener] += 1
            if inner:
                h, e = np.concatenate(inner), np.concatenate(inner_ends)
                u, at = np.unique(h, return_inverse=True)
                rows.append(pd.DataFrame({"kind": "c", "h": u.view(np.int64), "tail": 0, "n": np.bincount(at), "e": np.bincount(at, weights=e).astype(int)}))
            beginnings: Counter[tuple[int, str]] = Counter()
            for (v, w), n in pairs.items():
                if w in corpus.ids:
                    for j in range(least_prefix, len(w)):
                        beginnings[(v, w[:j])] += n
            for kind, pair in (("b", pairs), ("p", beginnings)):
                h = np.array([(v ^ _word_id(w)) & 0xFFFFFFFFFFFFFFFF for v, w in pair], np.uint64).view(np.int64)
                rows.append(pd.DataFrame({"kind": kind, "h": h, "tail": 0, "n": list(pair.values()), "e": 0}))
            rows.append(pd.DataFrame({"kind": "o", "h": np.array(list(openers), np.uint64).view(np.int64), "tail": 0, "n": list(openers.values()), "e": 0}))
            kinds, hs_, tails = zip(*last, strict=True) if last else ((), (), ())
            rows.append(pd.DataFrame({"kind": list(kinds), "h": np.array(hs_, np.uint64).view(np.int64), "tail": np.array(tails, np.uint64).view(np.int64), "n": 1, "e": 1}))
            yield pd.concat(rows)[["kind", "h", "tail", "n", "e"]].astype({"h": "int64", "tail": "int64", "n": "int64", "e": "int64"})

    return count


ENDING = (
    "doc_id long, source string, rule string, omitted boolean, wanted array<struct<kind:string,k:int,h:long>>, "
    "short boolean, lengths array<long>"
)
MEASURES = ("characters", "utf8 bytes", "utf16 units", "entities", "json escapes", "crlf characters", "crlf bytes")


def lengths(text: str) -> list[int]:
    """The length of a text under each of ``MEASURES``."""
    breaks = text.count("\n") - text.count("\r\n")
    marks = sum(text.count(c) * n for c, n in (("&", 4), ("<", 3), (">", 3), ('"', 5)))
    escapes = sum(text.count(c) for c in '"\\\n\r\t')
    utf8 = len(text.encode("utf-8", "surrogatepass"))
    utf16 = len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text)
    return [len(text), utf8, utf16, len(text) + marks, len(text) + escapes, len(text) + breaks, utf8 + breaks]


def _endings(corpus: _Corpus):
    order = corpus.settings.order
    stop, start = corpus.ids[STOP], corpus.ids[START]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, body, omitted, toks in _texts(pdf):
                ids = corpus.classed(toks)
                while len(ids) and ids[-1] in (stop, start):
                    ids, toks = ids[:-1], toks[:-1]
                kind = rule(body, omitted, toks)
                wanted, short = [], False
                if kind is None:
                    hs = _hashes(ids, order)
                    wanted = [("c", k + 1, int(hs[k][-1:].view(np.int64)[0])) for k in range(min(order, len(ids)))]
                    if len(ids) > 1 and toks[-1][0].isalpha():
                        pair = np.array([(int(ids[-2]) ^ _word_id(toks[-1])) & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64)[0]
                        wanted += [("b", 1, int(pair)), ("p", 1, int(pair))]
                    begin = max(i for i in range(len(ids)) if ids[i] in (stop, start)) if len(ids) else 0
                    if begin + 1 < len(ids):
                        opener = corpus.opener(toks[begin + 1], hs, begin + 1, len(ids))
                        wanted.append(("o", 1, int(np.array([opener], np.uint64).view(np.int64)[0])))
                        short = len(ids) - begin - 1 <= corpus.settings.formula_words
                out.append((kind, omitted, wanted, short, lengths(pdf["text"].iloc[n])))
            frame = pd.DataFrame(out, columns=["rule", "omitted", "wanted", "short", "lengths"])
            frame.insert(0, "source", pdf["source"].to_numpy())
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame

    return read


def plain_source(source: Column) -> Column:
    """Sources in lower case with underscores; null and blank stay apart as ``(none)``."""
    name = F.regexp_replace(F.lower(F.btrim(source)), r"[\s_-]+", "_")
    return F.when(F.length(name) > 0, name).otherwise("(none)")


@dataclass(frozen=True)
class Truncation:
    documents: DataFrame  # doc_id, source, probability, measure, size_limit
    sources: DataFrame  # source, documents, open_endings, truncated, share
    limits: DataFrame  # source, measure, size_limit, texts, expected


def truncation(documents: DataFrame, settings: Settings = Settings()) -> Truncation:
    """Truncated documents, limits and shares of each source, from ``doc_id, source, text``.

    Null, empty and blank texts are no case. Repeated ids count once; reposted texts are each reported and count
    once as evidence. An empty table gives empty results; other columns are ignored.
    """
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND length(btrim(text)) > 0").select(
        "doc_id", plain_source(F.col("source")).alias("source"), "text"
    )
    total = texts.count()
    corpus = _Corpus(_lexicon(texts.select("text"), total, settings), settings)
    counted = texts.select("text").mapInPandas(_counts(corpus), "kind string, h long, tail long, n long, e long")
    ends = durable(texts.mapInPandas(_endings(corpus), ENDING).dropDuplicates(["doc_id"]))
    wanted = durable(ends.select(F.explode("wanted").alias("x")).select("x.kind", "x.h").distinct())
    held = (
        counted.join(wanted, ["kind", "h"], "left_semi")
        .groupBy("kind", "h", "tail").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
        .groupBy("kind", "h").agg(
            F.sum(F.when(F.col("tail") == 0, F.col("n")).otherwise(0)).alias("inner"),
            F.sum(F.when(F.col("tail") == 0, F.col("e")).otherwise(0)).alias("inner_ends"),
            F.count_if(F.col("tail") != 0).alias("last"),
        )
    )
    judged = _judged(ends, held, settings)
    limits, placed = _limits(judged, settings)
    scored = durable(_scored(judged, placed, settings))
    cut = scored.where("probability > 0.5")
    sources = (
        ends.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("rule").isNull()).alias("open_endings"))
        .join(cut.groupBy("source").agg(F.count(F.lit(1)).alias("truncated")), "source", "left")
        .select("source", "documents", "open_endings", F.coalesce("truncated", F.lit(0)).alias("truncated"))
        .withColumn("share", F.col("truncated") / F.col("documents"))
    )
    return Truncation(cut.select("doc_id", "source", "probability", "measure", "size_limit"), sources, limits)


BASE = 0.08  # rate at which words end a sentence in running text, where no context is known


def _judged(ends: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """Open endings with ``p_end``, the chance that the last words are followed by an end."""
    asked = ends.where("rule IS NULL").select("doc_id", "source", "short", "lengths", F.explode("wanted").alias("x")).select(
        "doc_id", "source", "short", "lengths", "x.*"
    )
    # the document's own ending is no evidence: its tail is counted once among the last ones of its context
    seen = asked.join(held, ["kind", "h"], "left").select(
        "doc_id", "source", "short", "lengths", "kind", "k", F.coalesce("inner", F.lit(0)).alias("inner"),
        F.coalesce("inner_ends", F.lit(0)).alias("inner_ends"), F.greatest(F.coalesce("last", F.lit(0)) - 1, F.lit(0)).alias("last"),
    )
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    each = seen.groupBy("doc_id").agg(
        F.first("source").alias("source"), F.first("short").alias("short"), F.first("lengths").alias("lengths"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "c", F.struct("k", (F.col("inner") + F.col("last")).alias("n"), (F.col("inner_ends") + F.col("last")).alias("e"))))).alias("c"),
        of("b", "inner").alias("whole"), of("p", "inner").alias("longer"), of("o", "inner").alias("opens"), of("o", "last").alias("closes"),
    )
    b = settings.backing
    p = F.aggregate("c", F.lit(BASE), lambda p, x: (x["e"] + b * p) / (x["n"] + b))
    word_cut = (F.col("whole") == 0) & (F.col("longer") > 0)
    formula = F.col("short") & (F.col("closes") >= settings.formula_least) & (
        F.col("closes") >= settings.formula_share * (F.col("closes") + F.col("opens"))
    )
    return durable(each.select(
        "doc_id", "source", "lengths",
        F.when(word_cut, 0.001).when(formula, 0.999).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))).alias("p_end"),
    ))


def _limits(judged: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Hidden limits, and for each document near one the odds of being cut there."""
    each = judged.select("doc_id", "source", F.posexplode("lengths").alias("m", "l"))
    counts = each.groupBy("source", "m", "l").agg(F.count(F.lit(1)).alias("n"))
    # lengths around: shared cells of a tenth of the length, so no window runs over a whole source
    cell = F.floor(F.log(1.1, F.greatest(F.col("l"), F.lit(1)))).cast("int")
    celled = counts.withColumn("cell", cell)
    around = celled.groupBy("source", "m", "cell").agg(F.sum("n").alias("all"), F.max("n").alias("peak"), F.max_by("l", F.struct("n", "l")).alias("l"))
    two = around.select("source", "m", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), "all")
    near = two.groupBy("source", "m", "cell").agg(F.sum("all").alias("near"))
    span = F.pow(F.lit(1.1), F.col("cell") + 2) - F.pow(F.lit(1.1), F.col("cell") - 1)
    spikes = around.join(near, ["source", "m", "cell"]).select(
        "source", "m", F.col("l").alias("size_limit"), F.col("peak").alias("texts"),
        ((F.col("near") - F.col("peak") + 1) / span).alias("expected"),
    ).where((F.col("texts") >= settings.limit_least) & (F.col("texts") >= settings.limit_excess * F.col("expected")))
    spikes = durable(spikes)
    # one storage limit shows under several measures: each document stands for its largest spike only
    own = each.join(spikes.withColumnRenamed("size_limit", "l"), ["source", "m", "l"]).groupBy("doc_id", "source").agg(
        F.max(F.struct("texts", -F.col("m"), "l")).alias("s")
    )
    kept = own.groupBy("source", (-F.col("s.col2")).alias("m"), F.col("s.l").alias("size_limit")).agg(F.count(F.lit(1)).alias("texts")).where(
        F.col("texts") >= settings.limit_least
    )
    limits = durable(kept.join(spikes.drop("texts"), ["source", "m", "size_limit"]))
    room = F.explode(F.sequence(F.col("size_limit") - settings.word_room, F.col("size_limit")))
    zone = limits.select("source", "m", "size_limit", "texts", "expected", room.alias("l"))
    inside = each.join(zone, ["source", "m", "l"])
    below = inside.where("l < size_limit").groupBy("source", "m", "size_limit").agg(F.count(F.lit(1)).alias("below"))
    at = F.col("l") == F.col("size_limit")
    odds = F.when(at, F.greatest(F.col("texts") - F.col("expected"), F.lit(1.0)) / F.col("expected")).otherwise(
        F.greatest(F.col("below") - settings.word_room * F.col("expected"), F.lit(0.0)) / (settings.word_room * F.col("expected"))
    )
    placed = inside.join(below, ["source", "m", "size_limit"], "left").select("doc_id", "m", "size_limit", odds.alias("odds"))
    best = placed.groupBy("doc_id").agg(F.max(F.struct("odds", "m", "size_limit")).alias("b")).select("doc_id", "b.*")
    named = F.element_at(F.array(*(F.lit(x) for x in MEASURES)), F.col("m") + 1)
    return limits.select("source", named.alias("measure"), "size_limit", "texts", "expected"), best.select(
        "doc_id", named.alias("measure"), "size_limit", "odds"
    )


def _scored(judged: DataFrame, placed: DataFrame, settings: Settings) -> DataFrame:
    ratio = (1 - F.col("p_end")) / (1 - BASE) / (F.col("p_end") / BASE)  # cut to finished, given the context
    rows = durable(judged.join(placed, "doc_id", "left").select("doc_id", "source", "measure", "size_limit", "odds", ratio.alias("ratio")))
    # the mixing odds of all other open endings, from a histogram of bounded size
    bins = rows.groupBy(F.round(F.ln("ratio"), 1).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    r, n = np.exp(np.array([x["b"] for x in bins], float)), np.array([x["n"] for x in bins], float)
    odds = 1.0
    for _ in range(50):
        cut = (n * (odds * r) / (odds * r + 1)).sum() if len(n) else 0.0
        odds = min(max(cut / max(n.sum() - cut, 1e-9), 1e-3), 1e3) if len(n) else 1.0
    fit = F.greatest(F.lit(odds), F.coalesce("odds", F.lit(0.0))) * F.col("ratio")
    return rows.select("doc_id", "source", "measure", "size_limit", (fit / (fit + 1)).alias("probability"))
