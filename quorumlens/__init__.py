"""Consensus analytics over large document collections, on Spark DataFrames."""
