"""Spark-native engine for versioned, dated document collections."""
