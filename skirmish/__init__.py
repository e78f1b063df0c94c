"""Skirmish: combat-log analytics as Spark DataFrames, Spark SQL and Structured Streaming."""
