"""Locusloom: association summary statistics as ordinary Spark DataFrames."""
