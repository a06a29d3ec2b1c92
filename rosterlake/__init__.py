"""Entity-base analytics on Spark DataFrames."""
