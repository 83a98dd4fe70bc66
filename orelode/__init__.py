"""A Spark-native analytics engine for evidence retrieval."""
