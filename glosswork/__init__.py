"""Document-retrieval and evaluation analytics on Spark DataFrames."""
