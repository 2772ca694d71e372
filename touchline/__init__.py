"""Football-event analytics on Spark DataFrames."""
