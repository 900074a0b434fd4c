"""Keyed limits and job events, in batch and in Structured Streaming."""
