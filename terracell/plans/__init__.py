"""Plans made of several operators: alignment of cubes, and ingest recipes."""
