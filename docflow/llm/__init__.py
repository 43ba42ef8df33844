"""Training-data operators.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.  Every operator takes DataFrames and returns DataFrames,
selects the columns it needs before anything else (so extra columns of any name
do no harm) and states in its docstring what nulls, empty texts, ties, repeated
rows and empty tables give.
"""
