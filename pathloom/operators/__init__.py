"""operators of pathloom."""
