"""Operators chained into complete analyses."""
