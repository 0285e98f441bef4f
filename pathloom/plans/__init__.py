"""plans of pathloom."""
