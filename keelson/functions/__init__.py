"""Column expression library (pure expressions, no Python UDFs)."""
