"""Ledger analytics on Spark.

Every operator takes DataFrames and returns DataFrames built from native
Spark expressions, so Catalyst can prune, push down and plan the work.
"""

__version__ = "0.1.0"
