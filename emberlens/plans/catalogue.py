"""All queries of the engine by name, with SQL for DuckDB that gives the same rows."""

from emberlens.plans import incident_queries, picture_queries, regional_queries, series_queries, service_queries, views

__all__ = ["ORACLES", "QUERIES", "incident_queries", "picture_queries", "regional_queries", "series_queries", "service_queries"]
QUERIES, ORACLES = views.QUERIES, views.ORACLES
