"""grainmill: grouped-measurement analytics on Spark DataFrames."""
