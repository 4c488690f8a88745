"""Labour-market analytics on Spark DataFrames."""
