"""Operators of the map engine."""
