"""Spark-native operators over property graphs, versions of data and review records."""
