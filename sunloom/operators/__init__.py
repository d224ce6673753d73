"""DataFrame operators: each takes DataFrames and column names and returns a DataFrame."""
