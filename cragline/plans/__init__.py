"""plans of cragline."""
