"""Structured Streaming forms of the arrival-ordered operators."""
