"""Registered queries and their SQL equivalents."""

from . import derive_queries, registry_queries, select_queries, session_queries, store_queries, track_queries

MODULES = (track_queries, select_queries, derive_queries, registry_queries, store_queries, session_queries)
