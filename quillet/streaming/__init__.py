"""Structured Streaming operators of the refinement service."""
