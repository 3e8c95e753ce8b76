"""quirefold: line-aware document text analytics on Spark DataFrames."""
