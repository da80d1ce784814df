"""The entry points, composed from the operators: search, ask, sources."""
