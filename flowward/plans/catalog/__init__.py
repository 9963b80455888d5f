"""Every operator as a named query over the test tables, with the SQL that gives the same answer."""

from flowward.plans.catalog import dashboards, ingest, integrity, linked, modelling, profiling_queries, streams, upkeep  # noqa: F401
from flowward.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
