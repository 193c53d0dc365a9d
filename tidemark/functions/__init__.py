"""Column functions: built-in expressions only, except the vector codec."""
