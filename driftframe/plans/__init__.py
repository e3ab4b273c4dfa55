"""Comparison plans: two schemas and a configuration merged into one tree, without touching data."""
