"""Readers of sequencing files and of the small tables that a run needs; each gives the schema of readqc.schema."""
