"""Column functions and small DataFrame helpers."""
