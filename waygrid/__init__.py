"""waygrid: road-network analytics on Spark DataFrames."""
