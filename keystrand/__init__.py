"""Keystrand: ordered, versioned keyspaces as Spark DataFrames."""
