"""Document retrieval, citation analytics and corpus preparation on Spark DataFrames."""
