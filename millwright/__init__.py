"""Machine-hour feature engine: telemetry, incidents and reference data to a supervised hourly table."""
