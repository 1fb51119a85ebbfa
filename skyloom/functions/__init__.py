"""Column builders: pixel geometry, physics, bins."""
