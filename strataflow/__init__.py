"""Versioned evidence-graph analytics expressed with Spark DataFrames."""
