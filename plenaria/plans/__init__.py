"""Composite queries: each answers one public question with DataFrames."""
