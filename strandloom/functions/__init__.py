"""Column functions: k-mer codes, k-mer features, names and paths."""
