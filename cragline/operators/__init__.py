"""operators of cragline."""
