"""Analytics over event-driven service-dependency graphs, on Spark DataFrames."""
