"""Analytics over market bars and quotes, declared on Spark DataFrames."""
