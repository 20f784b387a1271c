"""Sources: parquet tables, derived audit frames and policy tables."""
