"""Code and corpus analytics on Spark DataFrames."""
