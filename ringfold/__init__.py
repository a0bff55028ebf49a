"""Shape matching and street-network analytics on Spark DataFrames."""
