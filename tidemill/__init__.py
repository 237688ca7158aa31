"""A PySpark-native engine for event analytics."""
