"""Functions of the map engine."""
