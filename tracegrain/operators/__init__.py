"""Operators on traces, items and rates."""
