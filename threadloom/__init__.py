"""Spark-native analytics over corpora of discussion threads."""
