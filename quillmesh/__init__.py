"""Spark-native entity resolution and temporal network analytics."""
