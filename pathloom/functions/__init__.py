"""functions of pathloom."""
