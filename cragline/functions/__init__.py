"""functions of cragline."""
