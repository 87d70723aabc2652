"""Analytics over communication archives, event streams and text corpora, on Spark DataFrames."""
