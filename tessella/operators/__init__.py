"""Statistical operators on DataFrames."""
