"""A reconciliation engine on Spark DataFrames."""
