"""Signal and time-series analytics on Spark DataFrames."""
