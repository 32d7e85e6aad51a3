"""histra: transaction-history analytics on Spark DataFrames."""
