"""Predictive-maintenance analytics on machine telemetry, as Spark DataFrame operators."""
