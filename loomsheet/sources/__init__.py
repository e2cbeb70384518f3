"""Models on disk, tables as DataFrames, model generation."""
