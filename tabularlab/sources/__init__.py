"""Sources and sinks: driver tables, CSV/JSON/text scans, partitioned parquet."""
