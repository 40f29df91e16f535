"""Column expressions and the few vectorised Python functions."""
