"""Queries over the driver's tables, with the equivalent SQL."""

from __future__ import annotations

from quernel.plans import checks, files, flow, graph, lookup, sql_tools

QUERIES = lookup.QUERIES | graph.QUERIES | flow.QUERIES | checks.QUERIES | files.QUERIES | sql_tools.QUERIES
ORACLES = lookup.ORACLES | graph.ORACLES | flow.ORACLES | checks.ORACLES | files.ORACLES | sql_tools.ORACLES
