"""Knowledge-base analytics on Spark: DataFrames in, DataFrames out."""
