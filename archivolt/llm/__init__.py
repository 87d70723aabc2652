"""Operations of a large training-data pipeline, one module each.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin contract queries built from them.
"""
