"""Sports-results analytics on Spark: DataFrames in, DataFrames out."""
