"""Structured Streaming variants of the pipeline."""
