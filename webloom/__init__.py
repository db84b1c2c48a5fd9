"""Batch analytics for web-crawl data on Spark DataFrames."""
