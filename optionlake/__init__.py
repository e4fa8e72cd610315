"""Option-surface analytics on Spark DataFrames."""
