"""Spark jobs for document-retrieval corpora: layout, chunks, vectors, search, collections, catalog."""
