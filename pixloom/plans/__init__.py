"""Plans of the resampling engine."""
