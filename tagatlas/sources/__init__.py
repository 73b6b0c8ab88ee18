"""Sources of the map engine."""
