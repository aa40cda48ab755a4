"""A Spark-native engine for searching collections of source files and documents."""
