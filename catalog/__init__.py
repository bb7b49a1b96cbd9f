"""Registered queries: each operator on the test tables, next to the same question in SQL."""
