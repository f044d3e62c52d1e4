"""sievelight: personal-data and secret scanning on Spark DataFrames."""

__version__ = "0.1.0"
