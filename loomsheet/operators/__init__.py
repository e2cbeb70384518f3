"""Queries, the compiler, reports and statements."""
