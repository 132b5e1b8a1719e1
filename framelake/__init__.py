"""A Spark-native engine for screen-recording analytics."""
