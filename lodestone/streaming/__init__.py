"""Structured Streaming around the extractor."""
