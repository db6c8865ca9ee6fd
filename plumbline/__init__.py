"""A Spark-native engine for measurement and reliability analytics."""
