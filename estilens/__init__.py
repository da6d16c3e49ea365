"""Review of monthly survey estimates on Spark.

Every operator is a function from DataFrames to DataFrames.  Nothing here
collects, caches or keeps state: callers compose operators, filter them down to
a single selection if they want one, and run one Spark action.
"""
