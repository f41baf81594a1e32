"""Knowledge-graph and text-evaluation work on Spark DataFrames."""
