"""Document knowledge-base engine on Spark DataFrames."""
