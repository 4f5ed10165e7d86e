"""Column functions and helpers."""
