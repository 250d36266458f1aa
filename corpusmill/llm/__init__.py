"""Training-data operators: each module holds one, over plain DataFrames. Nothing else in the library imports this package."""
