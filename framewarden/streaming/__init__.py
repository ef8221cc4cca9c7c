"""Operators with state over frames: trackers and galleries, as batch and as Structured Streaming."""
