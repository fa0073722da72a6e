"""A Spark-native engine for hybrid document retrieval and the analytics around it."""
