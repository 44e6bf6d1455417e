"""Quality control of sequencing reads on Spark, and operators for large tables."""

__version__ = "0.1.0"
