"""Supply-chain lakehouse and graph analytics on Spark DataFrames."""
