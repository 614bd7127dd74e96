"""Batch and streaming analytics over archives of image measurements, on Spark DataFrames."""
