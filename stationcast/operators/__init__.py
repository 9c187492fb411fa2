"""DataFrame operators; each takes and returns DataFrames with column names as parameters."""
