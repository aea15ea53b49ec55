"""Case-review analytics on Spark: every operator maps DataFrames to DataFrames."""
