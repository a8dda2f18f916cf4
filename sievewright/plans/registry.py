"""Registered queries of the engine and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from . import queries_filings, queries_opportunities, queries_orders, queries_reports

FLAGSHIP = "top5_pareto_select"
QUERIES = {**queries_opportunities.QUERIES, **queries_orders.QUERIES, **queries_filings.QUERIES, **queries_reports.QUERIES}
ORACLES = {**queries_opportunities.ORACLES, **queries_orders.ORACLES, **queries_filings.ORACLES, **queries_reports.ORACLES}
