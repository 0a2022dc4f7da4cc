"""Localization-corpus engine: DataFrame in, DataFrame out, on Spark."""
