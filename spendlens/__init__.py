"""Advertising and client-health analytics as Spark DataFrame operators."""
