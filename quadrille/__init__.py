"""Tile-based visual analytics as DataFrame plans."""
