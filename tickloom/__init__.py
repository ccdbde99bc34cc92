"""tickloom: analytics for tick-based replay logs as plain Spark DataFrame operations."""
