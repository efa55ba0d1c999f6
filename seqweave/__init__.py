"""Relative compression of sequence collections as Spark tables, and queries on the compressed form."""
