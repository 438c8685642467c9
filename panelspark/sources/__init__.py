"""Scans of landed files with explicit schemas, and sinks."""
