"""Metadata quality, entity matching and corpus preparation as Spark DataFrame operators."""
