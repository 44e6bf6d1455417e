"""Operators for training-data pipelines: scoring, search, joins, packing, tokenising, placement.

Nothing else in the package imports this subpackage.
"""
