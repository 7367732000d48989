"""Training-data operators: ten jobs over document tables, each a function of DataFrames."""
