"""Plans of the terrain engine."""
