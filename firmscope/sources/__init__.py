"""Sources and sinks: raw delimited/zip ingest, lookups, CSV export, and the
adapter from the driver's test tables."""
