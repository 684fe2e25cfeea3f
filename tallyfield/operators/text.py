"""Transcriptions: cleaning, alignment, votes on characters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import align
from ..kernels import cluster as kernels
from ..session import durable, spread
from .pointers import components

LINE = ["workflow_id", "subject_id", "line"]


def clean(text: Column) -> Column:
    """Texts without line-break tags, font tags, hard blanks and question marks for gaps; null-safe, outer blanks gone.

    A text over several lines counts as no line and becomes empty.
    """
    out = F.regexp_replace(text, r"(?i)</?br\s*/?>|</?font[^>]*>|&nbsp;?|\?\?\?", "")
    out = F.btrim(F.regexp_replace(out, "&amp;", "&"))
    return F.when(F.contains(text, F.lit("\n")), "").otherwise(out)


def without_tags(text: Column) -> Column:
    """Texts without the mark-up that volunteers add in brackets or as short tags."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"\[/?[a-z]+\]|</?(?:sw-)?[a-z]+>", ""), r"\s+", " "))


def label_text(text: Column, most: int = 50) -> Column:
    """A safe name: at most ``most`` characters, blanks as underscores, only letters, digits and underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, " ", "_"), r"[^A-Za-z0-9_]", ""), 1, most)


def normalised_distance(a: Column, b: Column) -> Column:
    """Edit distance over the length of the longer text; 0 for two empty ones."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


def lines(marks: DataFrame, spacing: float = 15.0) -> DataFrame:
    """``workflow_id, subject_id, line, volunteer, id, x, text``: text marks by the line of the page they lie on.

    The line is the mark's middle height over ``spacing``; of a volunteer's marks on one line all count.
    """
    text = marks.where("shape = 'text' AND text IS NOT NULL")
    middle = (F.get("params", F.lit(2)) + F.get("params", F.lit(3))) / 2
    return text.select("workflow_id", "subject_id", F.round(middle / spacing).cast("int").alias("line"), "volunteer", "id", F.get("params", F.lit(0)).alias("x"),
                       without_tags(clean(F.col("text"))).alias("text")).where("text <> ''")


def variants(marks: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """``workflow_id, subject_id, variant, volunteers``: spellings noted with marks by at least ``least`` of the ``known`` volunteers."""
    each = marks.where("shape = 'text'").select("workflow_id", "subject_id", "volunteer", F.explode("variants").alias("v"))
    each = each.select("workflow_id", "subject_id", "volunteer", F.btrim("v").alias("variant")).where("variant <> ''")
    counts = each.join(known, "volunteer", "left_semi").groupBy("workflow_id", "subject_id", "variant").agg(F.count_distinct("volunteer").alias("volunteers"))
    return counts.where(F.col("volunteers") >= least)


def line_variants(rows: DataFrame) -> DataFrame:
    """``LINE, text, n``: how many volunteers wrote each text on a line."""
    return rows.groupBy(*LINE, "text").agg(F.count_distinct("volunteer").alias("n"))


def consensus_lines(rows: DataFrame, share: float = 0.65, most: int = 500) -> DataFrame:
    """``LINE, text, agreement, texts, volunteers``: characters voted on after aligning a line's texts.

    Equal texts are counted first, so a line that very many volunteers wrote is aligned from its variants. Lines with
    more than ``most`` variants are voted on in chunks of that many by hash, then the chunks' results are voted on,
    with every chunk counting for its volunteers.
    """
    variants = rows.groupBy(*LINE, "text").agg(F.count_distinct("volunteer").alias("n"))
    sizes = variants.groupBy(*LINE).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("chunks"), F.sum("n").alias("volunteers"), F.count(F.lit(1)).alias("texts"))
    placed = variants.join(sizes, LINE).withColumn("chunk", F.pmod(F.xxhash64("text"), F.col("chunks")).cast("int"))
    schema = "workflow_id int, subject_id long, line int, text string, n long, agreement double"
    voted = durable(spread(placed, *LINE, "chunk").applyInPandas(_voted(share), schema).join(sizes, LINE))
    several = voted.where("chunks > 1").select(*LINE, "text", "n", "agreement").groupBy(*LINE).applyInPandas(_voted(share), schema)
    out = voted.where("chunks = 1").select(*LINE, "text", "agreement").unionByName(several.select(*LINE, "text", "agreement"))
    return out.join(sizes, LINE).select(*LINE, "text", "agreement", "texts", "volunteers")


def reduced_variants(variants: DataFrame, key: list[str], share: float = 0.65, most: int = 500) -> DataFrame:
    """``key, text, n`` with at most as many rows for a key as it has chunks of ``most`` different texts.

    Keys with no more than ``most`` texts keep them as they are; of others each chunk (by hash) becomes the text it
    votes for, with all its volunteers.
    """
    sizes = variants.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("chunks"))
    placed = durable(variants.join(sizes, key).withColumn("chunk", F.pmod(F.xxhash64("text"), F.col("chunks")).cast("int")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in variants.select(*key).schema.fields)

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text")
        line, _ = align.vote(align.align(pdf["text"].tolist()), share, [int(n) for n in pdf["n"]])
        return pdf[key].head(1).assign(text=line.replace(align.GAP, "").replace(align.DISAGREE, "?"), n=int(pdf["n"].sum()))

    many = spread(placed.where("chunks > 1"), *key, "chunk").applyInPandas(vote, f"{kinds}, text string, n long")
    return placed.where("chunks = 1").select(*key, "text", "n").unionByName(many)


def _voted(share: float):
    def voted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text")
        texts, n = pdf["text"].tolist(), pdf["n"].tolist()
        line, agreement = align.vote(align.align(texts), share, [int(k) for k in n])
        own = float(pdf["agreement"].mean()) if "agreement" in pdf and len(pdf) else 1.0
        head = pdf.iloc[0]
        plain = line.replace(align.GAP, "").replace(align.DISAGREE, "?")
        return pd.DataFrame({c: [head[c]] for c in LINE} | {"text": [plain], "n": [sum(n)], "agreement": [min(agreement, own)]})

    return voted


def character_votes(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key, at, character, n``: votes on every place of texts of equal length (aligned ones)."""
    return rows.select(*key, F.posexplode(F.split("text", "")).alias("at", "character")).where("character <> ''").groupBy(*key, "at", "character").agg(F.count(F.lit(1)).alias("n"))


def decided(votes: DataFrame, key: list[str], share: float = 0.65) -> DataFrame:
    """``key, text``: the character with at least ``share`` of the votes at each place, ``?`` where none has."""
    totals = votes.groupBy(*key, "at").agg(F.sum("n").alias("all"), F.max(F.struct("n", "character")).alias("top"))
    each = totals.select(*key, "at", F.when(F.col("top.n") >= share * F.col("all"), F.col("top.character")).otherwise("?").alias("c"))
    return each.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]), "").alias("text"))


def connected_lines(marks: DataFrame, within: float = 10.0) -> DataFrame:
    """``workflow_id, subject_id, id, item, component`` of text marks whose segments lie along each other.

    Marks are cut into bands of the page by height first, so a page with very many marks is many small tasks; a band
    overlaps the next by the distance, and components of all bands that share marks are joined, over any number of bands.
    """
    text = marks.where("shape = 'text'").select("workflow_id", "subject_id", "id", "item", "params", F.xxhash64("id", "item").alias("node"))
    height = 200.0
    low = F.floor((F.least(F.get("params", F.lit(2)), F.get("params", F.lit(3))) - within) / height)
    high = F.floor((F.greatest(F.get("params", F.lit(2)), F.get("params", F.lit(3))) + within) / height)
    banded = text.withColumn("band", F.explode(F.sequence(low, high)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        p = np.array(pdf["params"].tolist(), float)
        parts = align.connected(p[:, [0, 2, 1, 3]], within)
        rows = [(int(pdf["node"][i]), int(pdf["node"][c[0]])) for c in parts for i in c]
        return pd.DataFrame(rows, columns=["node", "component"])

    found = spread(banded, "workflow_id", "subject_id", "band").applyInPandas(join, "node long, component long")
    least = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return text.join(least, "node").select("workflow_id", "subject_id", "id", "item", "component")


def string_clusters(texts: list[str], cut: float = 0.65) -> list[list[int]]:
    """Texts in groups by Ward's linkage on their normalised edit distances, cut at a height."""
    n = len(texts)
    d = np.array([[align.levenshtein(a, b) / max(len(a), len(b), 1) for b in texts] for a in texts]).reshape(n, n)
    return kernels.components(n, _below(kernels.ward(d), n, cut))


def _below(merges, n: int, cut: float):
    leaf = {i: i for i in range(n)}
    for step, (a, b, h, _) in enumerate(merges):
        leaf[n + step] = leaf[a]
        if h <= cut:
            yield leaf[a], leaf[b]
