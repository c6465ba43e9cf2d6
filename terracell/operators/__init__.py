"""Operators on cubes: subsetting, values, regridding, merging, reducing."""
