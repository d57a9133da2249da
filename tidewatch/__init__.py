"""tidewatch: analytics over telemetry tables, written as Spark DataFrame programs."""
