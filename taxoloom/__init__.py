"""Concept taxonomies over large tables, as Spark DataFrame jobs."""
