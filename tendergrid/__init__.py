"""Public-procurement analytics on Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "schemas", "session", "sources", "streaming"]
