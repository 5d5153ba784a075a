"""Library operators."""
