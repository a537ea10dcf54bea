"""A typed, exact query language on Spark DataFrames."""
