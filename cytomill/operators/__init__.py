"""DataFrame operators; each takes DataFrames and explicit parameters and returns a DataFrame."""
