"""Spark-native policy and document analytics."""
