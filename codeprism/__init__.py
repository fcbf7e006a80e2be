"""Spark-native analytics over source corpora, diffs, event logs and labelled samples."""
