"""A Spark-native engine for scoring card transactions by vector similarity."""
