"""Table operators: every function here maps DataFrames to a DataFrame."""
