"""Sources of multisets."""
