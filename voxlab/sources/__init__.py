"""Scans, sinks and the stand-in adapters for the driver's test tables."""
