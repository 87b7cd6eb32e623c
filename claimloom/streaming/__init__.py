"""Stateful operators, as batch and as Structured Streaming."""
