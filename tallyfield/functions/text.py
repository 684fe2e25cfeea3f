"""Words of texts, regardless of letter case, accents, mark-up, entities, punctuation and spacing."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities that stand for characters of mark-up or space, as patterns.
ENTITIES = (
    ("(?i)&(nbsp|#160|#xa0|ensp|emsp|thinsp);", " "),
    ("(?i)&(lt|#60|#x3c);", "<"),
    ("(?i)&(gt|#62|#x3e);", ">"),
    ("(?i)&(quot|ldquo|rdquo|#34|#x22);", '"'),
    ("(?i)&(apos|lsquo|rsquo|#39|#x27);", "'"),
    ("(?i)&(amp|#38|#x26);", "&"),
)
TAGS = r"</?[A-Za-z][^<>]*>|<!--.*?-->|\[/?[A-Za-z][A-Za-z0-9=_-]*\]"
# Apostrophes and marks inside words that are dropped without parting the word.
INSIDE = "'’‘ʼ`´­​‌‍⁠﻿"


@cache
def _plain_letters() -> tuple[str, str]:
    """Characters with a compatible single plain character, and that character; derived from Unicode's own tables."""
    source, target = [], []
    for code in [*range(0xA0, 0x2000), *range(0x2100, 0x2190), *range(0xFF00, 0xFFF0)]:
        ch = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain != ch and not unicodedata.combining(ch):
            source.append(ch)
            target.append(plain)
    marks = [chr(c) for c in [*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100)]]
    return "".join(source + marks + list(INSIDE)), "".join(target)  # what has no counterpart is dropped


def without_markup(text: Column) -> Column:
    """Text with entities resolved (twice where they are escaped twice) and tags replaced by blanks."""
    escaped = text
    for pattern, plain in (*ENTITIES, *ENTITIES):
        escaped = F.regexp_replace(escaped, pattern, plain)
    resolved = F.when(F.contains(text, F.lit("&")), escaped).otherwise(text)
    tagless = F.regexp_replace(resolved, TAGS, " ")
    return F.when(F.contains(resolved, F.lit("<")) | F.contains(resolved, F.lit("[")), tagless).otherwise(resolved)


def folded(text: Column) -> Column:
    """Lower case without accents, marks and apostrophes; ligatures are taken apart."""
    source, target = _plain_letters()
    plain = F.translate(F.lower(text), source, target)
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    return plain


def words(text: Column) -> Column:
    """Array of words: runs of letters and digits of the folded text without mark-up; null for null."""
    parts = F.split(folded(without_markup(text)), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")
