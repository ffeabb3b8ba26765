"""Column expressions and small UDF wrappers."""
