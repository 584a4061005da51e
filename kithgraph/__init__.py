"""Spark-native social network analysis."""
