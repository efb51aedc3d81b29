"""Headcast: arrival-forecast analytics and training-data operators on PySpark DataFrames."""
