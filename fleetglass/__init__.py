"""Fleet telemetry analytics on Spark: batch DataFrame jobs and Structured Streaming queries."""
