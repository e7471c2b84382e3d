"""golang of cragline."""
