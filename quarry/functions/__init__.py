"""Functions of quarry."""
