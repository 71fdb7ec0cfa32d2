"""Registered queries: inputs derived from the given tables, Spark plans and SQL twins."""
