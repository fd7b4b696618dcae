"""Keyed state over time, as batch windows and as Structured Streaming."""
