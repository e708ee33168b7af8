"""Declarative rules and training-data operators on Spark DataFrames."""
