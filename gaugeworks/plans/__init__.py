"""Report rules compiled to DataFrames of cells."""
