"""Training-data operators: ten corpus-scale passes over documents and embeddings."""
