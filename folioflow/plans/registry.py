"""All queries of the library, and the SQL of those that SQL can express."""

from __future__ import annotations

from folioflow.plans import analytics, flows, reports, rules

QUERIES = {**analytics.QUERIES, **rules.QUERIES, **flows.QUERIES, **reports.QUERIES}
SQL = {**analytics.SQL, **rules.SQL, **flows.SQL, **reports.SQL}
