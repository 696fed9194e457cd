"""Reference-verification analytics on Spark DataFrames."""
