"""A Spark-native insight engine."""
