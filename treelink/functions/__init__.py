"""Column expressions: portable random numbers, tree distance, link probability."""
