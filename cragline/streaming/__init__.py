"""streaming of cragline."""
