"""Column functions: planar geometry, derived values, labels and text."""
