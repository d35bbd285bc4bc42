"""Retail purchase analytics and two-stage recommendation on Spark DataFrames."""

__version__ = "0.1.0"
