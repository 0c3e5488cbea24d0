"""Independent SQL for every registered query, in DuckDB's dialect."""
