"""Registered queries of the usage engine and their SQL oracles."""

from __future__ import annotations

from tallyforge.plans import catalog, file_catalog, stream_catalog

QUERIES = catalog.QUERIES | stream_catalog.QUERIES | file_catalog.QUERIES
SQL = catalog.SQL | stream_catalog.SQL | file_catalog.SQL
