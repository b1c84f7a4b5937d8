"""Spark-native operators for scene, catalogue, geometry and usage-event data."""
