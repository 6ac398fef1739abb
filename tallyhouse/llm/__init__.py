"""Operations of a large training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; ``queries.py`` holds the thin registered queries.
"""
