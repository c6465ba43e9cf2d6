"""Spark-native analytics over catalogued, gridded data cubes."""
