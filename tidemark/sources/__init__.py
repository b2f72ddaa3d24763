"""Sources and sinks: landing files, curated versioned tables, JDBC, forecast JSON, job status."""
