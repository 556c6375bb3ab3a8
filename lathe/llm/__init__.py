"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage; ``queries.py`` registers its
queries with the driver entry point.
"""
