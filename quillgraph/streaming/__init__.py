"""Structured Streaming over events and change logs."""
