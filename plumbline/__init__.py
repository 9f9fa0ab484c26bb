"""Point-in-time company fundamentals and relative valuation on Spark DataFrames."""

__version__ = "0.1.0"
