"""Sources of the resampling engine."""
