"""Structured Streaming forms of the period roll-ups and novelty rules."""
