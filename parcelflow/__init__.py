"""A Spark-native analytics engine for property transactions."""
