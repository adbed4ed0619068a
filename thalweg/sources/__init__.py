"""Sources of the terrain engine."""
