"""Document, vector and graph analytics expressed as Spark DataFrames."""
