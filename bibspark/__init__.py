"""Spark-native analytics over bibliographic records and document corpora."""
