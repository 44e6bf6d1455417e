"""Column expressions and numerics."""
