"""Who made a classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space, the four separators of the C0 controls,
# and the two invisible spaces without width.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　​﻿"
)


def user_key(user_name: Column | str = "user_name", user_ip: Column | str = "user_ip") -> Column:
    """Name without outer white space in lower case; where nothing is left, the address; null where both lack."""
    name = F.col(user_name) if isinstance(user_name, str) else user_name
    ip = F.col(user_ip) if isinstance(user_ip, str) else user_ip
    bare = F.lower(F.btrim(name, F.lit(WHITE_SPACE)))
    return F.when(F.length(bare) > 0, bare).otherwise(ip)


def version_rank(version: Column) -> Column:
    """A sortable form of dotted versions: ``1.9`` comes before ``1.10``; parts that aren't numbers count as 0."""
    return F.transform(F.split(version, r"\."), lambda part: F.coalesce(part.try_cast("int"), F.lit(0)))
