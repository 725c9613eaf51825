"""slipweave: record linkage and data processing for scanned payment documents on Spark DataFrames."""
