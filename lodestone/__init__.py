"""Lodestone: a Spark-native engine for building and querying document knowledge bases."""
