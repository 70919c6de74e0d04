"""Incident reconstruction from security telemetry as DataFrame operators."""
