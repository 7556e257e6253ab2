"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import asset_queries, codec_queries, container_queries, frequency_queries, loader_queries, markup_queries, mesh_queries, optimize_queries, raster_queries, record_queries, sample_queries, text_queries  # noqa: F401
from tessera.plans.mesh_queries import flagship
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
