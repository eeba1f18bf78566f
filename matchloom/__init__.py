"""A Spark-native engine for matching text records against requirements, and for judging such matching."""
