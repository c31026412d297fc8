"""tallyforge: annotation and evaluation analytics on Spark DataFrames."""
