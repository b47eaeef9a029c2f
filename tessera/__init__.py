"""Spark-native property-graph analytics over code symbols."""
