"""Ordered, composable data pipelines on Spark DataFrames."""
