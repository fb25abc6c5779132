"""Desktop-telemetry process analytics on Spark."""
