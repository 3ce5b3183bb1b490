"""chronofold: bitemporal fact analytics, hybrid retrieval and maintenance on Spark DataFrames."""
