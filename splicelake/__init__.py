"""Gene, transcript and protein-domain analytics on Spark DataFrames."""
