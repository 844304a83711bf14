"""Queries over the test tables, each beside independent SQL for the same result."""
