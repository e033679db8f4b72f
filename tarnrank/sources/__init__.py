"""Readers with explicit schemas, sinks, and views over the driver tables."""
