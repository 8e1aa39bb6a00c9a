"""Reports built from the operators; each takes a DataFrame and returns DataFrames."""
