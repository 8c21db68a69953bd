"""Flow-field and particle-trajectory analytics on Spark DataFrames."""
