"""concord: multi-source record integration on Spark DataFrames."""
