"""Structured Streaming twins of the rolling operators."""
