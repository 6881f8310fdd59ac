"""Evidence-backed analytics as Spark DataFrames."""
