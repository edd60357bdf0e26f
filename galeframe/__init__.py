"""Spark-native analytics of wind-speed distributions."""
