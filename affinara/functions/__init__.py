"""Column functions: text, similarity, vectors and LSH bands."""
