"""spanloom: annotated-text (standoff span) analytics on Spark DataFrames."""
