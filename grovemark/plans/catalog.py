"""Registry of the analytics queries; each module of plans adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.operators import graph, quality
from grovemark.plans import alignment_queries, calibration_queries, calmap_queries, curation_queries, error_queries, extraction_queries, fixtures, graph_queries, more_queries, nested_queries, ontology_queries, protocol_queries, quality_queries, report_queries, retrieval_queries, scalar_queries, selection_queries, source_queries, span_queries, staging_queries, text_queries, traversal_queries, view_queries, vote_queries
from grovemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
_MODULES = (quality_queries, graph_queries, vote_queries, calibration_queries, more_queries, text_queries, traversal_queries, retrieval_queries, curation_queries, protocol_queries, scalar_queries, error_queries, span_queries, calmap_queries, nested_queries, alignment_queries, selection_queries, ontology_queries, report_queries, source_queries, extraction_queries, staging_queries, view_queries)
_Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical and flat quality in one row."""
    g, p = fixtures.gold(spark, sf_dir), fixtures.pred(spark, sf_dir)
    flat = quality.micro(g, p).select(*[F.col(c).alias(f"flat_{c}") for c in ("precision", "recall", "f1")])
    return graph.cohort(graph.h_counts(g, p, fixtures.closed(spark, sf_dir))).crossJoin(flat)
