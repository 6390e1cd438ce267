"""Training-data operators over documents, embeddings and conversations; nothing outside this folder imports them."""
