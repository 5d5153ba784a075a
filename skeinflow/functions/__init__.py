"""Library functions."""
