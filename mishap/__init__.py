"""mishap: a PySpark-native engine for knowledge bases of error messages."""
