"""Operators on canonical tables: joins, windows, roll-ups and views."""
