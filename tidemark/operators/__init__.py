"""Operators over journals as DataFrames."""
