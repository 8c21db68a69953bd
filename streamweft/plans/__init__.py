"""Particle tracing plans: vectorised kernels and rounds of DataFrames."""
