"""PySpark-native analytics over map graphs: density, tiling, distribution."""
