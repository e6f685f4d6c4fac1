"""Retrieval evaluation on Spark: chunk, index, retrieve, score, compare."""
