"""Fire-detection and forest-monitoring analytics on Spark DataFrames."""
