"""Composed plans over the test tables and the query catalog."""
