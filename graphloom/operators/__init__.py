"""Operators over node, edge, summary and example DataFrames."""
