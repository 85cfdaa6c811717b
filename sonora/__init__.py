"""Sonora: event detection over recorded signals, expressed as Spark DataFrame transformations."""
