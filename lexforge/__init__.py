"""lexforge: corpus analytics on Spark DataFrames."""
