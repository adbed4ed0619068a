"""Operators of the terrain engine."""
