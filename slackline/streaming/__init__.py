"""Structured Streaming: running work functions and violation counts."""
