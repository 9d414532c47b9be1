"""Analytics on catalogues of events in space and time, built on Spark DataFrames."""
