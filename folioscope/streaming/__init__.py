"""Structured Streaming over event tables; each has a batch twin of the same name in ``plans``."""
