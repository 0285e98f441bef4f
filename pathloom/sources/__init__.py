"""sources of pathloom."""
