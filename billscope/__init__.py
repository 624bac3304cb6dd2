"""Spark-native analytics for legislative-style records.

Operators take DataFrames, column names and parameters and return lazy DataFrames.
"""
