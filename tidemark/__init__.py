"""Conversion-feature operators on PySpark: DataFrames and Columns in, DataFrames and Columns out."""
