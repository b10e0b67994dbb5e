"""Document-field resolution on Spark DataFrames, set at a time."""
