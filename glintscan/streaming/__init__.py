"""Continuous form of the incremental re-scan."""
