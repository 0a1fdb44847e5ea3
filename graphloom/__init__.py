"""Code-knowledge graphs and instruction data as Spark DataFrames."""
