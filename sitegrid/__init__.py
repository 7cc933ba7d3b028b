"""sitegrid: dimension-keyed, row-aligned record tables as lazy Spark DataFrames."""
