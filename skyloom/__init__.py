"""Sky-catalogue analytics on Spark DataFrames."""
