"""Streaming of the map engine."""
