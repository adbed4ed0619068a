"""Streaming of the terrain engine."""
