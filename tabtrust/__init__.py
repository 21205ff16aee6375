"""Tabular data-trust analytics as DataFrame plans for Apache Spark."""
