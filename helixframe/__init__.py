"""Spark-native analytics of sequencing reads."""
