"""Lexical, document and training-data analytics on Spark DataFrames."""
