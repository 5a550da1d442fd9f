"""Streaming of the resampling engine."""
