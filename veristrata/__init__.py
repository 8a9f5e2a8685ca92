"""Set-at-a-time verification of numeric claims, and the queries around it, on Spark DataFrames."""
