"""sources of cragline."""
