"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHOLE = 100_000  # longer texts are encoded in pieces cut at line ends or blanks, so that merges stay fast


@cache
def encoding(path: str):
    """The tokenizer of a rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(encode, text: str) -> int:
    """Tokens of a text; special tokens' strings count as ordinary text, lone surrogates as the replacement sign."""
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() else text
    total, at = 0, 0
    while len(text) - at > WHOLE:
        # a blank belongs to the word behind it, so a piece may end before any single blank or line end
        cut = max(text.rfind(" ", at + 1, at + WHOLE), text.rfind("\n", at + 1, at + WHOLE))
        cut = cut if cut > at and not text[cut - 1].isspace() and not text[cut + 1 : cut + 2].isspace() else at + WHOLE
        total, at = total + len(encode(text[at:cut])), cut
    return total + len(encode(text[at:]))


def sized(texts: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """``texts`` with ``tokens`` in place of ``text`` (0 for null and empty texts)."""
    path = f"{folder}/{ranks}"

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            pdf["tokens"] = [count(encode, t) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pdf.drop(columns="text")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text")
    return texts.mapInPandas(size, f"{schema}, tokens long")
