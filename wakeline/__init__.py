"""Point-in-time analytics for small competing groups, on Spark DataFrames."""
