"""Structured Streaming forms of the operators that can run on a stream."""
