"""trellis: knowledge graphs over tabular data, built on Spark DataFrames."""
