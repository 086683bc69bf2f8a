"""Tallyloom: work-item dispatch, run telemetry and status analytics as Spark plans."""
