"""Sources and sinks: parquet tables, CSV, JSON audit logs, model files."""
