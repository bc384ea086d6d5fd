"""Analytics over image files and their metadata, declared as Spark DataFrames."""
