"""Review operators: DataFrames in, DataFrames out."""
