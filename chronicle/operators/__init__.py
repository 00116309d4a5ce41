"""Insight operators: each takes fact DataFrames and Params and returns a lazy DataFrame."""
