"""Registered queries of the core and their SQL."""

from stepmill.queries import core, more, reports, skew, sources

QUERIES = {**skew.QUERIES, **core.QUERIES, **more.QUERIES, **reports.QUERIES, **sources.QUERIES}
SQL = {**skew.SQL, **core.SQL, **more.SQL, **reports.SQL, **sources.SQL}
