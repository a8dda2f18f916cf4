"""Streaming forms of the filing scan."""
