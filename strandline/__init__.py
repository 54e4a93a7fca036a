"""Lineage and provenance analytics as Spark DataFrame operators."""
