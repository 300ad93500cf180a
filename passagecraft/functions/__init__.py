"""Column functions with the semantics that retrieval needs."""
