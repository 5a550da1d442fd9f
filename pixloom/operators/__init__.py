"""Operators of the resampling engine."""
