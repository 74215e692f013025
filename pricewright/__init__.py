"""Price-observation analytics on Spark DataFrames."""
