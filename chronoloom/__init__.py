"""An always-temporal entity store and query engine on Spark DataFrames."""
