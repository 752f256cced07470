"""Queries over the given tables: views, Spark queries, equivalent SQL."""
