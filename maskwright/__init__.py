"""Spark-native detection, masking and analysis of sensitive data in text columns."""
