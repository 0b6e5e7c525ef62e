"""Sparse distributed representations and stream analytics on Spark DataFrames.

An SDR is a column ``array<int>`` of sorted, distinct, active bit numbers below a size that the expression's author knows.
"""
