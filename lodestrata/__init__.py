"""Spark-native near-duplicate analytics over large item collections."""
