"""Structured Streaming monitors over job logs."""
