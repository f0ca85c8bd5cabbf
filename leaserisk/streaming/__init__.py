"""Structured Streaming monitors with batch twins."""
