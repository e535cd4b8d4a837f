"""Run-date driven table operators for layered (bronze / silver / gold) pipelines on Spark.

Every operator is a function from DataFrames to a DataFrame. The run date is an
argument; no operator reads the clock, so running a date again gives the same table.
"""

__version__ = "0.1.0"
