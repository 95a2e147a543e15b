"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; the thin ``op*_`` queries over the
standard tables are in :mod:`quernstone.llm.queries`.
"""
