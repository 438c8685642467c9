"""Spark-native analytics over entity x period panels."""
