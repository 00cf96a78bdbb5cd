"""Operators Spark does not ship: similarity join, extraction, scoring, co-mentions."""
