"""Wayfold: trajectory and sensor time-series analytics on Spark DataFrames."""
