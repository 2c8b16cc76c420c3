"""Vector analytics on Spark DataFrames: feature vectors, nearest-neighbour scoring, inverted-file search."""
