"""A Spark-native engine for preparing, searching and evaluating document collections."""
