"""Importing any module of this package registers every query."""

from corpusloom.plans import compile_queries, graph_queries, job_queries, lifecycle_queries, manifest_queries, ops_queries, plugin_queries, retrieval_queries, segment_queries, state_queries  # noqa: F401
