"""Keeping results: upsert, documents, report files."""

from __future__ import annotations

import tarfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with the same keys (nulls equal nulls)."""
    same = [stored[k].eqNullSafe(new[k]) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return new.unionByName(stored.join(new, condition, "left_anti"), allowMissingColumns=True)


def touched(history: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``history`` whose keys occur in ``new``: what must be aggregated again."""
    return history.join(new.select(*keys).distinct(), keys, "left_semi")


def documents(results: DataFrame, keys: list[str], column: str = "result") -> DataFrame:
    """``keys, <column>``: the other columns of each row as one JSON object, null fields left out."""
    rest = [c for c in results.columns if c not in keys]
    return results.select(*keys, F.to_json(F.struct(*rest)).alias(column))


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    """A folder of CSV parts with header under a safe name; arrays, maps and structs are written as JSON."""
    safe = "".join(c if c.isalnum() or c == "_" else "" for c in name.replace(" ", "_"))[:50] or "report"
    plain = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields]
    path = f"{folder.rstrip('/')}/{safe}"
    df.select(*plain).write.mode("overwrite").option("header", True).csv(path)
    return path


def pack(folder: str, target: str) -> str:
    """Everything in a local folder as one compressed archive (for report folders, which are small)."""
    with tarfile.open(target, "w:gz") as tar:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file() and not p.name.startswith((".", "_")):
                tar.add(p, arcname=str(p.relative_to(folder)))
    return target
