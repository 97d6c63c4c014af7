"""Market-evidence analytics and training-data operators on Spark DataFrames."""
