"""Document retrieval and evidence operators on Spark DataFrames."""
