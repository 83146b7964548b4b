"""Structured Streaming over the audit log."""
