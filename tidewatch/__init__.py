"""tidewatch: operational analytics on Spark DataFrames."""
