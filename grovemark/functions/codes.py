"""Expressions on codes, flags and scores as files spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_codes(cell: Column) -> Column:
    """The codes of a cell: a list literal, or parted by semicolons, or else by commas; trimmed, without quotes, blanks and
    repeats, in first-seen order. Null is empty."""
    bare = F.regexp_replace(F.coalesce(cell, F.lit("")), r"^\s*\[|\]\s*$|[\"'‘’“”]", "")
    parts = F.when(bare.contains(";"), F.split(bare, ";")).otherwise(F.split(bare, ","))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda c: c != ""))


def normal_code(c: Column, prefix: str = "HP") -> Column:
    """Trimmed, with a colon after the prefix where an underscore or nothing stands."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), f"^({prefix}:)+", f"{prefix}:"), f"^{prefix}_?(?=[0-9])", f"{prefix}:")


def flag(c: Column) -> Column:
    """true, false, or null for anything else; case, blanks and a closing dot don't count."""
    low = F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"\.$", "")
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit(":"), F.lit("_"))


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def seconds(c: Column) -> Column:
    """Seconds of m:s or h:m:s; null for anything else."""
    p = F.transform(F.split(c, ":"), lambda x: x.try_cast("double"))
    return F.when(F.size(p).isin(2, 3), F.aggregate(p, F.lit(0.0), lambda a, x: a * 60 + x))
