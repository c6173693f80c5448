"""Quillmere: a Spark-native engine for document registries, chunking and hybrid retrieval."""
