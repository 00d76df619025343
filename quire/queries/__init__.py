"""Queries over the test tables, one module a family, each with QUERIES and SQL."""

from quire.queries import artifacts_drift, engine, responses, trees, workbooks

CORE = [trees, artifacts_drift, workbooks, responses, engine]
