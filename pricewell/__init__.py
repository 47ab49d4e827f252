"""Collectible-card price analytics as PySpark DataFrame operators."""
