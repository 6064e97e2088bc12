"""Document-quality analytics on Spark DataFrames."""
