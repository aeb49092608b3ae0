"""rankloom: leaderboard extraction and data preparation on PySpark DataFrames."""

__version__ = "0.1.0"
