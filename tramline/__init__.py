"""Tramline: transit-telemetry analytics written as plain Spark DataFrame operators."""
