"""A PySpark-native full-text search and text-data engine."""
