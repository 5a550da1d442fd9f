"""Functions of the resampling engine."""
