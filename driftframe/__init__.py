"""driftframe: keyed dataset comparison on Spark DataFrames."""
