"""Streaming front-end of the worklist."""
