"""The same frames over unbounded input."""
