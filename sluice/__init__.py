"""Sluice: a pipe-query analytics engine on Spark DataFrames."""
