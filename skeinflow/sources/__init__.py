"""Library sources."""
