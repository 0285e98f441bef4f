"""streaming of pathloom."""
