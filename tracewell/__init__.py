"""Analytics over network-media evidence on Spark DataFrames."""
