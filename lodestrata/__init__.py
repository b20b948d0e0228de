"""Spark-native analytics over indexed source code and the texts around it."""
