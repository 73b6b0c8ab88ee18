"""Plans of the map engine."""
