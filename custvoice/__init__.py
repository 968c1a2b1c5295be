"""Customer-voice analytics on Spark DataFrames."""
