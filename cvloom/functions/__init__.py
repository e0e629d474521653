"""Column functions: text in, scalar or nested values out."""
