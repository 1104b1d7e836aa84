"""Operators on track DataFrames."""
