"""Column functions over text, numbers and arrays."""
