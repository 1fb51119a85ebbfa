"""Scans and sinks: Parquet and text tables partitioned by time step."""
