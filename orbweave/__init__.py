"""orbweave: spatial perception analytics on Spark DataFrames."""
