"""Retrieval analytics on Spark: chunking, lexical and vector search, fusion, grading."""
