"""Panel analytics on Spark DataFrames: features, data quality, walk-forward splits and scaling."""
