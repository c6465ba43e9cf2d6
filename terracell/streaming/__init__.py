"""Cubes that grow while they are read."""
