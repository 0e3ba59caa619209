"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovemark.llm import chat_format, exact_dedup, mixing, packing, quality, secrets, sharding, simhash, topk, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        url_filter.op1_url_filter,
        mixing.op2_mixing,
        chat_format.op3_chat_format,
        exact_dedup.op4_exact_dedup,
        sharding.op5_sharding,
        quality.op6_quality,
        packing.op7_packing,
        secrets.op8_secrets,
        simhash.op9_simhash,
        topk.op10_topk,
    )
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.oracle(),
        "op2_mixing": mixing.oracle(),
        "op3_chat_format": chat_format.oracle(),
        "op4_exact_dedup": exact_dedup.oracle(),
        "op10_topk": topk.oracle(),
    }
