"""Repository-history analytics on Spark DataFrames."""
