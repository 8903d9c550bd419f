"""Column functions over vectors, names and small structures."""
