"""Semantic analytics on Spark: model once, ask for dimensions and measures, get DataFrames."""
