"""A PySpark-native analytics engine for long timed media and the conversations about it."""
