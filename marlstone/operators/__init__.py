"""Operators over catalog tables: DataFrame in, DataFrame out."""
