"""Ferrule: declarative business rules and log analytics as Spark expressions."""
