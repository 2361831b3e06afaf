"""Customer-journey analytics on PySpark DataFrames."""
