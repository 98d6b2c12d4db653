"""Column functions. None of them reads data or calls Python per row."""
