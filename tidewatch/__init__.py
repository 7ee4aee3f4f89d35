"""tidewatch: point-in-time surveillance analytics on Spark DataFrames."""
