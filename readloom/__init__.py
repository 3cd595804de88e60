"""readloom: sequencing reads as DataFrames, on Spark."""
