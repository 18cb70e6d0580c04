"""vecframe: nearest-neighbour joins over tables of dense vectors, on Spark DataFrames."""
