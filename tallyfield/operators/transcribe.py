"""Pages from volunteers' transcriptions: completed stretches of lines, and what is reported of them.

Volunteers may transcribe a part of a line only. The texts of a line are aligned; stretches that enough volunteers
cover are completed, their characters are voted on among those who cover them, and what they can't agree on is
spelled out. Equal texts of a line are counted first, so a line costs what its different texts cost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import align
from ..session import spread
from .text import LINE, clean, reduced_variants, without_tags

PAGE = ["workflow_id", "subject_id"]
FLAT, LEANING = 0.15, np.pi / 5  # radians: a line of text, and a single word


def direction(params: Column, text: Column) -> Column:
    """``horizontal`` for marks (x1, x2, y1, y2) along the lines of a page, a single word may lean further; else ``vertical``."""
    at = lambda i: F.get(params, F.lit(i))
    angle = F.atan2(F.abs(at(3) - at(2)), F.abs(at(1) - at(0)))
    single = F.size(F.split(F.btrim(text), r"\s+")) == 1
    return F.when((angle < FLAT) | (single & (angle < LEANING)), "horizontal").otherwise("vertical")


def page_lines(marks: DataFrame, spacing: float = 15.0) -> DataFrame:
    """``LINE, direction, volunteer, id, item, text, x1, x2, y1, y2`` of text marks with words.

    The line is the middle's height over ``spacing``, for vertical marks the middle's distance from the left.
    """
    rows = marks.where("shape = 'text' AND text IS NOT NULL").withColumn("text", without_tags(clean(F.col("text")))).where("text <> ''")
    at = lambda i: F.get("params", F.lit(i))
    rows = rows.withColumn("direction", direction(F.col("params"), F.col("text")))
    middle = F.when(F.col("direction") == "horizontal", (at(2) + at(3)) / 2).otherwise((at(0) + at(1)) / 2)
    return rows.select(*PAGE, F.round(middle / spacing).cast("int").alias("line"), "direction", F.col("volunteer").cast("string").alias("volunteer"), "id", "item", "text",
                       *(at(i).alias(n) for i, n in enumerate(("x1", "x2", "y1", "y2"))))


STRETCH = "workflow_id int, subject_id long, line int, direction string, block int, text string, rendered string, agreement double, volunteers long"


def completed(lines: DataFrame, least: int = 3) -> DataFrame:
    """``STRETCH, x1, x2, y1, y2``: stretches that at least ``least`` volunteers of a line cover, with the median ends of the line's marks.

    ``text`` has ``?`` where they disagree; ``rendered`` spells the options out; ``agreement`` is the share of places
    without disagreement. Lines with fewer volunteers give no row; empty tables give an empty result.
    """
    key = [*LINE, "direction"]
    ends = lines.groupBy(*key).agg(F.count_distinct("volunteer").alias("all"), *(F.median(c).alias(c) for c in ("x1", "x2", "y1", "y2"))).where(F.col("all") >= least)
    variants = lines.groupBy(*key, "text").agg(F.count_distinct("volunteer").alias("n")).join(ends.select(*key), key, "left_semi")

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text")
        rows, n = align.align(pdf["text"].tolist()), [int(k) for k in pdf["n"]]
        marked, head, out = [align.mark_outside(r) for r in rows], pdf.iloc[0], []
        for k, (a, b) in enumerate(align.blocks(rows, least, n)):
            part = [r[a : b + 1] for r in marked]
            covering = sum(c for r, c in zip(part, n, strict=True) if set(r) != {align.OUTSIDE})
            voted = align.vote_inside(rows, least, n)[a : b + 1]
            plain = voted.replace(align.GAP, "").replace(align.DISAGREE, "?").replace(align.FEW, "")
            out.append((*(head[c] for c in key), k, plain, align.render(voted, part), 1 - voted.count(align.DISAGREE) / len(voted), covering))
        return pd.DataFrame(out, columns=[*key, "block", "text", "rendered", "agreement", "volunteers"])

    found = spread(reduced_variants(variants, key), *key).applyInPandas(stretch, STRETCH)
    return found.join(ends.drop("all"), key)


def own_agreements(lines: DataFrame) -> DataFrame:
    """``LINE, direction, text, n, agreement``: of every text, the share of its places in which all who cover them agree."""
    key = [*LINE, "direction"]

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text").reset_index(drop=True)
        rows = align.align(pdf["text"].tolist())
        pdf["agreement"] = [align.own_agreement(rows, i) for i in range(len(rows))]
        return pdf[[*key, "text", "n", "agreement"]]

    variants = lines.groupBy(*key, "text").agg(F.count_distinct("volunteer").alias("n"))
    return spread(reduced_variants(variants, key), *key).applyInPandas(own, "workflow_id int, subject_id long, line int, direction string, text string, n long, agreement double")


def pages(stretches: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, lines, text, accuracy, volunteers``: a page's completed stretches in reading order, one a line.

    Horizontal lines come first, from the top, then vertical ones from the left; accuracy is the mean agreement.
    """
    order = F.struct((F.col("direction") == "vertical").alias("v"), "line", "block", "text")  # stretches of one page
    return stretches.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["text"]), "\n").alias("text"),
        F.avg("agreement").alias("accuracy"), F.max("volunteers").alias("volunteers"),
    )


def page_documents(stretches: DataFrame, variants: DataFrame, subjects: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, document``: a page's stretches with their places, its noted variants and its metadata as one JSON object.

    ``variants`` as from ``text.variants``, ``subjects`` has ``subject_id, metadata``. Raw transcriptions stay a table
    of their own (``page_lines``), as a page may have any number of them.
    """
    place = F.struct((F.col("direction") == "vertical").alias("vertical"), "line", "block", "rendered", "agreement", "volunteers", "x1", "x2", "y1", "y2")
    text = stretches.groupBy(*PAGE).agg(F.array_sort(F.collect_list(place)).alias("text"))
    noted = variants.groupBy(*PAGE).agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    rows = text.join(noted, PAGE, "left").join(subjects, "subject_id", "left")
    return rows.select(*PAGE, F.to_json(F.struct("metadata", "text", "variants")).alias("document"))
