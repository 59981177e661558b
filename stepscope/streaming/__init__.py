"""Structured Streaming form of the category rollup."""
