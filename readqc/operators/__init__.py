"""Operators over reads: each takes DataFrames and gives a small DataFrame of counts or shares, keyed by file_id."""
