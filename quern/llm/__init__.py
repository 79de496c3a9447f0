"""Operators of large-scale training-data pipelines.

Nothing outside this package imports it; ``queries`` and ``sql`` hold what the
driver entry file registers when the package is present.
"""
