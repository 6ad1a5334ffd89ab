"""Sources and sinks: parquet tables, text and page files, vector and JSON-lines exports."""
