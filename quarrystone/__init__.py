"""A Spark-native engine for building and querying hierarchical text collections."""
