"""Sources and sinks: driver-table fixtures, CSV/JSON/parquet readers and writers."""
