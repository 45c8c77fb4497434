"""Incremental posteriors over streams."""
