"""Expressions on ids, cells, margins, costs and grids. Each is null-safe as its docstring says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovemark.functions.codes import sigmoid

#: A prune score that is an indicator can be replayed only from caches built at one half or below.
INDICATOR_LIMIT = 0.5
#: Forward passes of one node, in units of a column maximum.
CALL_COST = 20.0
POOLINGS = ("P0", "P1", "P2", "P3", "P4")


def is_number(c: Column) -> Column:
    """Whether the trimmed text reads as a number."""
    return trimmed_number(c).isNotNull()


def trimmed_number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def whole_or_null(c: Column) -> Column:
    """The integer part of what reads as a number, else null."""
    return trimmed_number(c).try_cast("int")


def with_colon(c: Column) -> Column:
    """An id without a colon gets one after its first two characters."""
    return F.when(c.contains(":") | (F.length(c) <= 2), c).otherwise(F.concat(F.substring(c, 1, 2), F.lit(":"), F.substring(c, 3, 1 << 30)))


def single_prefix(c: Column, prefix: str = "HP") -> Column:
    """A doubled prefix made single; null for what does not begin with it."""
    one = F.trim(F.replace(c, F.lit(f"{prefix}:{prefix}:"), F.lit(f"{prefix}:")))
    return F.when(F.startswith(one, F.lit(f"{prefix}:")), one)


def ids_in(c: Column, prefix: str = "HP") -> Column:
    """All ids that a cell of any make holds, in order; a doubled prefix counts once."""
    return F.regexp_extract_all(F.coalesce(F.replace(c, F.lit(f"{prefix}:{prefix}:"), F.lit(f"{prefix}:")), F.lit("")), F.lit(f"({prefix}:[0-9]+)"), F.lit(1))


def id_digits(c: Column) -> Column:
    """The digits of a query that is an id but for blanks, marks and its prefix, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]", ""), "^hp", "")
    return F.when(bare.rlike("^[0-9]+$"), bare)


def flattened(c: Column) -> Column:
    """One cell: runs of blanks become one; a list is joined first. Null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def unescaped_blanks(c: Column) -> Column:
    """Backslash escapes of tab, newline and return become blanks."""
    return F.regexp_replace(c, r"\\[tnr]", " ")


def one_line(c: Column) -> Column:
    """Line ends become blanks, of the same number of characters."""
    return F.translate(c, "\r\n", "  ")


def target_key(source: Column, report: Column, term: Column, slot: Column) -> Column:
    """source|report|term, and |slot where there is one."""
    return F.concat_ws("|", source, report.cast("string"), term, slot.cast("string"))


def utc_stamp(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def containment_threshold(tau: Column) -> Column:
    """The largest threshold of a cache that holds every node a replay at tau in [0, 1) opens."""
    a = -F.log1p(-tau)
    return a / (1 + a)


def cache_supports(pooling: Column, tau: Column, tau_cache: Column) -> Column:
    """Whether a cache surely holds what the pooling opens at tau."""
    known = pooling.isin(*POOLINGS) & ~((pooling == "P0") & (tau_cache > INDICATOR_LIMIT))
    return known & (tau_cache <= containment_threshold(tau) + 1e-15)


def captured_mass(yes: Column, no: Column, lse: Column) -> Column:
    """Share of the probability that the two answers hold, from logits and the log of the whole sum."""
    top = F.greatest(yes, no)
    return F.exp(top + F.log1p(F.exp(-F.abs(yes - no))) - lse)


def gate_features(depth: Column, subtree: Column, margin: Column, median_depth: float) -> list[Column]:
    """A node's features; an unknown depth takes the median and a flag."""
    return [
        F.coalesce(depth.cast("double"), F.lit(median_depth)).alias("depth_long"),
        F.log1p(F.coalesce(subtree, F.lit(0)).cast("double")).alias("log1p_subtree_size"),
        margin.alias("margin_max"),
        depth.isNull().cast("double").alias("depth_long_missing"),
    ]


def gate(features: dict[str, Column], weights: dict[str, float], intercept: float) -> Column:
    """The logistic gate over named features."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + F.lit(w) * features[name]
    return sigmoid(z)


def node_cost(subtree: Column, dual: Column) -> Column:
    return F.log1p(F.coalesce(subtree, F.lit(0)).cast("double")) + F.lit(CALL_COST) * F.when(dual, 2.0).otherwise(1.0)


def snake_shard(place: Column, shards: int) -> Column:
    """The shard of the place-th item (from 0) dealt forth and back."""
    pos = place % shards
    return F.when(F.floor(place / shards) % 2 == 0, pos).otherwise(shards - 1 - pos)


def break_even(hours: Column, baseline: Column, method: Column) -> Column:
    """Reports after which set-up hours are won back; infinite where a report saves no time."""
    saving = baseline - method
    return F.when(saving > 0, hours * 3600 / saving).otherwise(F.lit(float("inf")))


def at_least_one(n: Column, p: Column) -> Column:
    """Chance that at least one of n passes a gate that each passes with p."""
    return 1 - F.pow(1 - p, n)


def depth_band(depth: Column) -> Column:
    return F.when(depth <= 1, "1").when(depth <= 3, depth.cast("string")).when(depth <= 5, "4-5").when(depth.isNotNull(), "6+")


def link_source(score: Column) -> Column:
    """Who chose a link: a score of -1 marks the model, 1 the dictionary, any other a similarity."""
    return F.when(score == -1.0, "llm").when(score == 1.0, "dictionary").when(score.isNotNull(), "retrieval")
