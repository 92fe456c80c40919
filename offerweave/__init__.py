"""Catalog matching, search and price analytics expressed as Spark DataFrame transforms."""
