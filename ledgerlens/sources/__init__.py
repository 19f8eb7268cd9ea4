"""Sources: parquet tables, the business views bound to them, files and sinks."""
