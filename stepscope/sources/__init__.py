"""Readers, table adapters and report sinks."""
