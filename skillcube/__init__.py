"""Verification of gridded forecasts on Spark DataFrames."""
