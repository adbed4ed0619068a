"""Functions of the terrain engine."""
