"""Panel forecast models."""
