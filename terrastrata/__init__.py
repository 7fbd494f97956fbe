"""terrastrata: spatial analytics on Spark DataFrames."""
