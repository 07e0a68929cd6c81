"""Curation and evaluation of time-aligned clip data on Spark DataFrames."""
