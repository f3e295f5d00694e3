"""Structure-scoring analytics on Spark DataFrames."""
