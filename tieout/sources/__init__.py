"""Scans, batches and sinks."""
