"""vecloom: vector search, hybrid retrieval and relational analytics on Spark DataFrames."""
