"""Registered queries: inputs derived from the test tables, Spark plans and their DuckDB counterparts."""
