"""Training-data operators: one module per operator, plain functions over DataFrames.

Nothing outside this subpackage imports it. Each module states the defined results for nulls,
empty and very long texts, ties, repeated rows and empty tables in its docstrings.
"""
