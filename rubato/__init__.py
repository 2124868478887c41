"""Time-aligned sequence analytics on Spark DataFrames."""
