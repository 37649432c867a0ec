"""DataFrame operators: facts, quality, filing text, retrieval, topics and question answering."""
