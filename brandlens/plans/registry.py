"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from brandlens.plans import analytics, crawls, decisions, names, research, rules, sites, streams, texts, workspace

#: The plan modules register their queries on import.
MODULES = (analytics, crawls, decisions, names, research, rules, sites, streams, texts, workspace)
QUERIES, ORACLE_SQL = analytics.QUERIES, analytics.ORACLE_SQL
