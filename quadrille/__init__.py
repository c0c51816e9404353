"""Linked-data aggregation jobs on Spark DataFrames."""
