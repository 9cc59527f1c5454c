"""Sources of quarry."""
