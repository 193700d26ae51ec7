"""Spatial, routing and calendar analytics over Spark DataFrames."""
