"""Counting and looking up DNA k-mers with Spark DataFrames."""
