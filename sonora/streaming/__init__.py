"""Operators with state over micro-batches."""
