"""Graph anonymisation analytics on Spark DataFrames."""
