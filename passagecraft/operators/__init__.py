"""Chunking, embedding, retrieval, answering, evaluation and index operators on DataFrames."""
