"""Structured Streaming over what arrives in folders."""
